"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeboard.llm import chat, classify, decontaminate, lm, mixing, pages as web_pages, pivots, prefixes, ranked, rules, simhash, substrings, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables."""

    def register(build):
        QUERIES[name] = lambda spark, folder: build(*[spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables])
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op1_source_mix",
    "documents",
    sql=r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
        FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 2.0::DOUBLE * source_size AS most,
                 CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
          FROM s),
    o AS (SELECT *, 1.5::DOUBLE * sum(source_size::DOUBLE) OVER ()
                    - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
          FROM w),
    l AS (SELECT arg_min(rest, most / weight) AS rest, arg_min(open, most / weight) AS open FROM o WHERE most * open > weight * rest),
    t AS (SELECT w.source, source_size,
                 CASE WHEN l.rest IS NULL OR most * l.open <= weight * l.rest THEN most ELSE weight * l.rest / l.open END AS target
          FROM w, l),
    r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM r)
    SELECT doc_id, size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM c""",
)
def source_mix(documents):
    return mixing.mixture(documents)


@query("op3_lm_score", "documents")
def lm_score(documents):
    return lm.scores(documents, lower=True)


@query(
    "op5_substring_dedup",
    "documents",
    sql=r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
    m AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s HAVING count(*) > 1),
    g AS (SELECT DISTINCT r, i + j AS k FROM (SELECT x.r, x.i FROM x JOIN m USING (s) WHERE m.first < x.doc_id), range(13) t(j)),
    l AS (SELECT r, list(k) AS ks FROM g GROUP BY r),
    k AS (SELECT doc_id, len(w) AS n, coalesce(len(ks), 0) AS gone,
                 CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda e, i: NOT list_contains(ks, i)) END AS kept
          FROM d LEFT JOIN l USING (r))
    SELECT doc_id, n::BIGINT AS n_words, gone::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
)
def substring_dedup(documents):
    return substrings.digests(documents)


@query("op9_simhash_dedup", "documents")
def simhash_dedup(documents):
    return simhash.near_duplicates(documents)


@query(
    "op7_benchmark_decontamination",
    "documents",
    "benchmark",
    sql=r"""
    WITH low AS (SELECT doc_id, row_number() OVER () AS r,
                        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                 FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
    p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
          FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    x AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
    h AS (SELECT r, i, x.n, item_id FROM x JOIN p ON x.n = p.n AND x.s = p.s),
    c AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM h, range(13) t(j) WHERE j < n GROUP BY r),
    t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM low LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
)
def benchmark_decontamination(documents, benchmark):
    return decontaminate.contamination(documents, benchmark)


@query("op6_quality_classifier", "documents", "labels")
def quality_classifier(documents, labels):
    return classify.scores(documents, labels)


@query("op8_html_extraction", "pages")
def html_extraction(pages):
    return web_pages.main_texts(pages)


@query("op4_quality_rules", "documents")
def quality_rules(documents):
    return rules.rated(documents)


@query("op10_token_counts", "documents")
def token_counts(documents):
    return tokens.counts(documents)


@query("op2_chat_repair", "conversations")
def chat_repair(conversations):
    return chat.repaired(conversations)


@query(
    "op11_prefix_trie",
    "conversations",
    sql=r"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (
        SELECT conv_id, conv_id - conv_id % 5 AS head,
               xor(4294967295::BIGINT, list_reduce(
                   list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM t)),
    s AS (
        SELECT c.conv_id, p, r, x FROM c JOIN t ON t.conv_id = c.head AND p <= h
        UNION ALL SELECT c.conv_id, p, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
    l AS (SELECT conv_id, coalesce(turns, []) AS turns
          FROM c LEFT JOIN (SELECT conv_id, list({'r': r, 'x': x} ORDER BY p) AS turns FROM s GROUP BY conv_id) USING (conv_id)),
    w AS (SELECT conv_id, len(turns) AS n, d, turns[1 : d] AS node, CASE WHEN d > 0 THEN strlen(turns[d].x) ELSE 0 END AS size
          FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM l)),
    n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
          FROM w GROUP BY node, d),
    k AS (SELECT w.node[1 : w.d - 1] AS node, w.d - 1 AS d, count(*) AS n_children FROM n w WHERE w.d > 0 GROUP BY 1, 2),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, above.conv_id AS parent_conv_id
          FROM n LEFT JOIN k ON n.node = k.node AND n.d = k.d LEFT JOIN n above ON above.d = n.d - 1 AND above.node = n.node[1 : n.d - 1]),
    u AS (SELECT a.node, a.d, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved_tokens
          FROM m JOIN w a ON a.conv_id = m.conv_id AND a.d <= m.d GROUP BY a.node, a.d)
    SELECT conv_id, m.d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
           n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
    FROM m JOIN u ON m.node = u.node AND m.d = u.d""",
)
def prefix_trie(conversations):
    return prefixes.respliced_trie(conversations)


@query(
    "op13_ranked_search",
    "documents",
    "benchmark",
    sql=r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
               FROM documents WHERE text IS NOT NULL),
    b AS (SELECT item_id, row_number() OVER () AS i,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE text IS NOT NULL),
    q AS (SELECT i, item_id, unnest(list_distinct(w)) AS t FROM b),
    s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
    p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY r, doc_id, n, t),
    f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, docs),
    h AS (SELECT i, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
          FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY i, item_id, r, doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM h WHERE score > 0)
    SELECT item_id, place::INTEGER AS rank, doc_id, score FROM o WHERE place <= 10""",
)
def ranked_search(documents, benchmark):
    return ranked.top_documents(documents, benchmark)


@query(
    "op12_top_vectors",
    "embeddings",
    sql="""
    WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
               FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, c.r AS other, list_sum(list_transform(list_zip(q.x, c.x, true), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS place FROM s)
    SELECT query_id, place::INTEGER AS rank, vec_id, score FROM o WHERE place <= 5""",
)
def top_vectors(embeddings):
    return pivots.top_vectors(embeddings)
