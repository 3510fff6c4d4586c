"""Catalogue lookups on the test tables.

Organisation, user, project, file and result become nation, customer, orders and
lineitem: each level is a child of the one before.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugeboard.operators import cascades as cas, catalog as cat, collections as coll, lifecycle as life
from gaugeboard.plans.profile_queries import rounded
from gaugeboard.plans.registry import Tables, query

# ---- filters and lookups ---------------------------------------------------


@query("tenant_filter", "SELECT * FROM customer WHERE c_nationkey = 7")
def tenant_filter(t: Tables):
    return cat.tenant_filter(t.customer, "c_nationkey", 7)


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
def point_lookup(t: Tables):
    return cat.lookup(t.orders, o_orderkey=42)


@query("composite_lookup", "SELECT * FROM lineitem WHERE l_orderkey = 42 AND l_linenumber = 3")
def composite_lookup(t: Tables):
    return cat.lookup(t.lineitem, l_orderkey=42, l_linenumber=3)


_RULES_SQL = {
    "content required": "text IS NOT NULL",
    "content too short": "length(text) >= 1",
    "content too long": "length(text) <= 1000",
    "unknown language": "lang IN ('en', 'fr', 'de')",
    "size must be positive": "n_chars > 0",
}


def _document_rules():
    return {
        "content required": F.col("text").isNotNull(),
        "content too short": F.length("text") >= 1,
        "content too long": F.length("text") <= 1000,
        "unknown language": F.col("lang").isin("en", "fr", "de"),
        "size must be positive": F.col("n_chars") > 0,
    }


@query(
    "rule_first_failure",
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN NOT coalesce({test}, false) THEN '{rule}'" for rule, test in _RULES_SQL.items())
    + " END AS failure FROM documents",
)
def rule_first_failure(t: Tables):
    return cat.first_failure(t.documents, _document_rules()).select("doc_id", "failure")


@query(
    "rule_violation_counts",
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE NOT coalesce({test}, false)) AS violations FROM documents"
        for rule, test in _RULES_SQL.items()
    ),
)
def rule_violation_counts(t: Tables):
    return cat.violation_counts(t.documents, _document_rules())


@query(
    "state_classification",
    """WITH used AS (SELECT l_orderkey AS token, count(*) AS uses FROM lineitem GROUP BY 1),
            invites AS (SELECT o_orderkey, o_orderstatus = 'P' AS revoked, o_orderdate + INTERVAL 7 DAY AS expires
                        FROM orders WHERE o_orderpriority <> '5-LOW')
       SELECT u.token AS token, CASE WHEN i.o_orderkey IS NULL THEN 'missing' WHEN i.revoked THEN 'revoked'
              WHEN TIMESTAMP '1998-01-01 00:00:00' > i.expires THEN 'expired' WHEN u.uses >= 5 THEN 'exhausted' ELSE 'valid' END AS state
       FROM used u LEFT JOIN invites i ON u.token = i.o_orderkey""",
)
def state_classification(t: Tables):
    used = t.lineitem.groupBy(F.col("l_orderkey").alias("token")).agg(F.count(F.lit(1)).alias("uses"))
    invites = t.orders.where(F.col("o_orderpriority") != "5-LOW").select(
        "o_orderkey", (F.col("o_orderstatus") == "P").alias("revoked"), F.expr("o_orderdate + INTERVAL 7 DAYS").alias("expires")
    )
    joined = used.join(invites, F.col("token") == F.col("o_orderkey"), "left")
    now = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz")
    state = cat.invite_state(
        F.col("o_orderkey").isNotNull(), F.col("revoked"), F.col("expires"), F.col("uses"), F.lit(5), now
    )
    return joined.select("token", state.alias("state"))


@query(
    "coalesce_defaults",
    """SELECT d.doc_id AS doc_id, coalesce(nullif(d.lang, ''), 'unknown') AS lang, coalesce(l.quality, 0) AS quality,
              coalesce(nullif(CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END, ''), 'No description') AS description
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def coalesce_defaults(t: Tables):
    from gaugeboard.functions.text import text_or

    labels = t.labels.withColumnRenamed("doc_id", "label_doc")
    joined = t.documents.select("doc_id", "lang").join(labels, F.col("doc_id") == F.col("label_doc"), "left")
    note = F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit(""))
    return joined.select(
        "doc_id",
        text_or(F.col("lang"), "unknown").alias("lang"),
        F.coalesce("quality", F.lit(0)).alias("quality"),
        text_or(note, "No description").alias("description"),
    )


# ---- children --------------------------------------------------------------


@query(
    "child_counts",
    """SELECT n.*, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers FROM nation n
       LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON n_nationkey = c.k
       LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s.k""",
)
def child_counts(t: Tables):
    children = {"n_customers": (t.customer, "c_nationkey"), "n_suppliers": (t.supplier, "s_nationkey")}
    return cat.child_counts(t.nation, "n_nationkey", children)


@query(
    "child_counts_files",
    """SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey
       ORDER BY c_custkey""",
)
def child_counts_files(t: Tables):
    parents = t.customer.select("c_custkey", "c_name")
    return cat.child_counts(parents, "c_custkey", {"n_orders": (t.orders, "o_custkey")}).orderBy("c_custkey")


@query(
    "any_match",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has_large
       FROM customer""",
)
def any_match(t: Tables):
    large = F.col("o_totalprice") > 400000
    return cat.any_match(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", large, "has_large")


@query(
    "latest_child",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_child(t: Tables):
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return cat.latest_child(orders, "o_custkey", "o_orderdate", "o_orderkey")


@query(
    "first_child",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def first_child(t: Tables):
    return cat.first_child(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey")


@query("feed_top50", "SELECT * FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def feed_top50(t: Tables):
    return cat.newest(cat.tenant_filter(t.events, "event_type", "purchase"), "ts", "event_id")


@query(
    "owner_list",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate DESC, o_orderkey",
)
def owner_list(t: Tables):
    own = cat.tenant_filter(t.orders, "o_custkey", 11).select("o_orderkey", "o_custkey", "o_orderdate")
    return own.orderBy(F.col("o_orderdate").desc(), "o_orderkey")


# ---- joins -----------------------------------------------------------------


@query("join_parent", "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey")
def join_parent(t: Tables):
    return cat.join_parent(t.orders, "o_custkey", t.customer, "c_custkey")


@query(
    "join_projected",
    """SELECT o_orderkey, o_custkey, o_orderdate, c_custkey, c_name, c_mktsegment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_projected(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return cat.join_parent(orders, "o_custkey", t.customer, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "join_nested_left",
    """SELECT c_custkey, c_name, o_orderkey, o_orderdate, n_lines FROM customer
       LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate FROM orders
                  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON c_custkey = o_custkey
       LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""",
)
def join_nested_left(t: Tables):
    latest = cat.latest_child(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    customers = t.customer.select("c_custkey", "c_name")
    joined = customers.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    joined = joined.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_orderdate", "n_lines")


@query(
    "feed_enriched",
    """WITH page AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'
                     ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)
       SELECT p.*, c_custkey, c_name, coalesce(r.mine, 0) > 0 AS has_reacted,
              coalesce(r.n, 0) AS reaction_count, coalesce(m.n, 0) AS comment_count
       FROM page p JOIN customer ON o_custkey = c_custkey
       LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_suppkey = 7) AS mine
                  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON p.o_orderkey = r.l_orderkey
       LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) m ON p.o_orderkey = m.l_orderkey""",
)
def feed_enriched(t: Tables):
    posts = cat.tenant_filter(t.orders, "o_orderpriority", "1-URGENT").select("o_orderkey", "o_custkey", "o_orderdate")
    return cat.feed(
        posts, "o_orderkey", "o_orderdate",
        users=t.customer, user_fk="o_custkey", user_pk="c_custkey", user_cols=["c_name"],
        reactions=t.lineitem.where("l_returnflag = 'R'"), comments=t.lineitem.where("l_returnflag = 'N'"),
        child_fk="l_orderkey", reactor="l_suppkey", current_user=7,
    )


@query(
    "nested_children",
    """WITH ranked AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
            pages AS (SELECT o_custkey, (rn - 1) // 4 AS page, count(*) AS n,
                             string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS children FROM ranked GROUP BY 1, 2)
       SELECT c_custkey, coalesce(page, 0) AS page, coalesce(n, 0) AS n_children, coalesce(children, '') AS children
       FROM customer LEFT JOIN pages ON c_custkey = o_custkey""",
)
def nested_children(t: Tables):
    nested = cat.nested_children(
        t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"], page_size=4
    )
    keys = F.transform("children", lambda c: c.getField("o_orderkey").cast("string"))
    return nested.withColumn("children", F.coalesce(F.array_join(keys, ","), F.lit("")))


@query(
    "semi_membership",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def semi_membership(t: Tables):
    open_orders = t.orders.where(F.col("o_orderstatus") == "P")
    return cat.members(t.customer.select("c_custkey", "c_name"), "c_custkey", open_orders, "o_custkey")


@query(
    "anti_missing_child",
    "SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def anti_missing_child(t: Tables):
    return cat.without_child(t.orders, "o_orderkey", t.lineitem, "l_orderkey")


@query(
    "cascade_survivors",
    """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2),
            c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
            o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
            l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
       SELECT 'nation' AS "table", count(*) AS rows FROM n UNION ALL SELECT 'customer', count(*) FROM c
       UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""",
)
def cascade_survivors(t: Tables):
    left = t.nation.where(F.col("n_regionkey") != 2)
    chain = [(t.customer, "c_nationkey", "n_nationkey"), (t.orders, "o_custkey", "c_custkey"), (t.lineitem, "l_orderkey", "o_orderkey")]
    tables = cat.cascade(left, chain)
    out = None
    for name, table in zip(("nation", "customer", "orders", "lineitem"), tables):
        part = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "cascade_rows",
    """SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2""",
)
def cascade_rows(t: Tables):
    """The rows that are left on the last level."""
    chain = [(t.customer, "c_nationkey", "n_nationkey"), (t.orders, "o_custkey", "c_custkey"), (t.lineitem, "l_orderkey", "o_orderkey")]
    return cat.cascade(t.nation.where(F.col("n_regionkey") != 2), chain)[-1].select("l_orderkey", "l_linenumber")


@query(
    "cascade_graph",
    """WITH RECURSIVE n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2),
            c(k) AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)
                     UNION SELECT c_custkey FROM customer JOIN c ON c_custkey // 3 = c.k AND c_custkey % 5 <> 0 AND c_custkey > 0),
            s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n) OR s_suppkey % 10 = 0),
            o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM c)),
            l AS (SELECT *, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM s) THEN NULL ELSE l_suppkey END AS kept FROM lineitem
                  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o))
       SELECT 'nation' AS "table", count(*) AS rows, sum(n_nationkey)::BIGINT AS keys, 0::BIGINT AS emptied FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM n)
       UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT, 0 FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)
       UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM s)
       UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT, 0 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
       UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT, count(*) FILTER (WHERE kept IS NULL) FROM l""",
)
def cascade_graph(t: Tables):
    """A region and some suppliers go.  Customers also hang on the customer who brought them; lines lose the supplier but stay."""
    brought = F.when((F.col("c_custkey") % 5 != 0) & (F.col("c_custkey") > 0), F.floor(F.col("c_custkey") / 3).cast("bigint"))
    tables = {"region": t.region, "nation": t.nation, "customer": t.customer.withColumn("brought_by", brought), "supplier": t.supplier, "orders": t.orders, "lineitem": t.lineitem}
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"]}
    references = [
        cas.Reference("nation", ("n_regionkey",), "region"),
        cas.Reference("customer", ("c_nationkey",), "nation"),
        cas.Reference("customer", ("brought_by",), "customer"),
        cas.Reference("supplier", ("s_nationkey",), "nation"),
        cas.Reference("orders", ("o_custkey",), "customer"),
        cas.Reference("lineitem", ("l_orderkey",), "orders"),
        cas.Reference("lineitem", ("l_suppkey",), "supplier", cas.SET_NULL),
    ]
    roots = {"region": t.region.where(F.col("r_regionkey") == 2), "supplier": t.supplier.where(F.col("s_suppkey") % 10 == 0)}
    done = cas.cascade_graph(tables, keys, references, roots)
    out = None
    for name in ("nation", "customer", "supplier", "orders", "lineitem"):
        left = done.survivors(name)
        key = (keys.get(name) or ["l_orderkey"])[0]
        emptied = F.count_if(F.col("l_suppkey").isNull()) if name == "lineitem" else F.lit(0).cast("long")
        part = left.agg(F.count(F.lit(1)).alias("rows"), F.sum(key).cast("long").alias("keys"), emptied.alias("emptied")).select(F.lit(name).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ---- audits ----------------------------------------------------------------


@query(
    "audit_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def audit_unique(t: Tables):
    return cat.audit_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "audit_fk",
    """SELECT l_orderkey, count(*) AS n_rows FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""",
)
def audit_fk(t: Tables):
    return cat.audit_fk(t.lineitem, "l_orderkey", t.orders.where(F.col("o_orderstatus") != "P"), "o_orderkey")


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "audit_nulls",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM customer" for c in _CUSTOMER),
)
def audit_nulls(t: Tables):
    return cat.audit_nulls(t.customer)


# ---- writes: upserts, sets, change logs ------------------------------------


@query(
    "upsert_latest",
    """WITH u AS (SELECT o_custkey AS k, o_totalprice AS v FROM orders
                  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
            b AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier)
       SELECT k, v FROM u UNION ALL SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM u)""",
)
def upsert_latest(t: Tables):
    base = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    updates = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    return cat.upsert(base, updates, ["k"], "o_orderkey")


@query(
    "insert_missing",
    """WITH i AS (SELECT user_id AS id, min('user-' || user_id) AS name, min(event_type) AS org FROM events GROUP BY 1),
            b AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'org' END AS org FROM supplier)
       SELECT b.id AS id, b.name AS name, coalesce(b.org, i.org) AS org FROM b LEFT JOIN i ON b.id = i.id
       UNION ALL SELECT id, name, org FROM i WHERE id NOT IN (SELECT id FROM b)""",
)
def insert_missing(t: Tables):
    base = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.lit("org")).alias("org")
    )
    incoming = t.events.select(
        F.col("user_id").alias("id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("org")
    )
    return cat.insert_missing(base, incoming, "id", fill=["org"])


@query(
    "union_dedup",
    """WITH e AS (SELECT event_id AS id, event_type AS kind, event_id AS seen_at FROM events WHERE event_type = 'view'),
            i AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_custkey AS seen_at FROM orders
                  UNION ALL SELECT l_orderkey, l_returnflag, l_partkey FROM lineitem),
            f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at, kind) = 1)
       SELECT * FROM e UNION ALL SELECT * FROM f WHERE id NOT IN (SELECT id FROM e)""",
)
def union_dedup(t: Tables):
    seen = t.events.where("event_type = 'view'").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("event_id").alias("seen_at")
    )
    incoming = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("seen_at")
    ).unionByName(
        t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("seen_at"))
    )
    return coll.union_dedup(seen, incoming, "id", "seen_at")


@query(
    "toggle_parity",
    """SELECT user_id, event_type, count(*) AS n_toggles FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
)
def toggle_parity(t: Tables):
    return coll.toggle_parity(t.events, ["user_id", "event_type"])


@query(
    "symmetric_difference",
    """WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT user_id AS k FROM events)
       (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)""",
)
def symmetric_difference(t: Tables):
    return coll.symmetric_difference(t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k")))


def event_changes(events):
    """Events as a change log: signup creates, error deletes, the rest update one field."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", coll.CREATE).when(kind == "error", coll.DELETE).otherwise(coll.UPDATE)
    score = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "user_id",
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.when(kind.isin("signup", "view"), F.col("value")).alias("amount"),
        F.when(kind.isin("signup", "click", "purchase"), score).alias("score"),
    )


CHANGES_SQL = """
    WITH log AS (SELECT user_id, event_id AS seq,
            CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
            CASE WHEN event_type IN ('signup', 'view') THEN value END AS amount,
            CASE WHEN event_type IN ('signup', 'click', 'purchase') THEN CAST(props->>'$.k' AS BIGINT) END AS score FROM events),
    d AS (SELECT user_id, max(seq) FILTER (WHERE op = 'delete') AS deleted FROM log GROUP BY 1),
    live AS (SELECT log.* FROM log JOIN d USING (user_id) WHERE seq > coalesce(deleted, -1)),
    c AS (SELECT user_id, min(seq) AS created FROM live WHERE op = 'create' GROUP BY 1),
    eff AS (SELECT live.* FROM live JOIN c USING (user_id) WHERE seq = created OR (op = 'update' AND seq > created))
    SELECT user_id, arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS amount,
           arg_max(score, seq) FILTER (WHERE score IS NOT NULL) AS score FROM eff GROUP BY 1"""


@query("apply_changes", CHANGES_SQL)
def apply_changes(t: Tables):
    return coll.apply_changes(event_changes(t.events), "user_id", "seq", "op", ["amount", "score"])


# ---- life cycle ------------------------------------------------------------


@query(
    "lifecycle_latest",
    """SELECT user_id, ts, event_id, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def lifecycle_latest(t: Tables):
    return life.current_status(t.events, "user_id", "event_type", ["ts", "event_id"])


@query(
    "lifecycle_dwell",
    """WITH s AS (SELECT user_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events)
       SELECT user_id, ts, event_id, event_type, until, round(date_diff('microsecond', ts, until) / 1e6, 6) AS seconds FROM s""",
)
def lifecycle_dwell(t: Tables):
    return rounded(life.dwell_times(t.events, "user_id", "event_type", "ts", ["ts", "event_id"]))


@query(
    "lifecycle_mean_dwell",
    """WITH s AS (SELECT event_type, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS seconds FROM events)
       SELECT event_type, count(seconds) AS stays, round(avg(seconds), 4) AS mean_seconds FROM s GROUP BY 1""",
)
def lifecycle_mean_dwell(t: Tables):
    return rounded(life.status_mean_dwell(t.events, "user_id", "event_type", "ts", ["ts", "event_id"]), 4)


_STEPS = (("signup", "view"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "purchase"), ("purchase", "view"))


@query(
    "lifecycle_invalid",
    f"""WITH s AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
        SELECT user_id, ts, event_id, event_type, previous FROM s
        WHERE previous IS NOT NULL AND (previous, event_type) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in _STEPS)})""",
)
def lifecycle_invalid(t: Tables):
    return life.forbidden_transitions(t.events, "user_id", "event_type", ["ts", "event_id"], _STEPS)
