"""Mixing sources to target weights, in DataFrame functions only.

Words are counted per source; sources share a budget by weight, no source beyond a multiple
of its own size (water filling).  A source's target over its size is its repetition rate: a
document is emitted floor(rate) times, and once more if a number drawn from the hash of seed,
id and text lies under the fraction.  A rerun draws the same numbers.

A NULL text has no words.  A NULL source is a source of its own, listed last.  A source without
words has target and rate 0, so its documents are not taken.  Rows equal in id and text share one draw.  An
empty table gives an empty result.  Further columns are kept whole and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.llm.texts import WORD, column, text_column, unpacked, whole_row
from gaugeboard.operators.ordered import with_position
from gaugeboard.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Rows (one per source) up to which the targets are broadcast: at most a few megabytes.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of seed, id and text."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Every pass fixes the sources whose share by weight reaches their limit and gives what is
    left to the others; a pass is one aggregate over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_position(
        materialize(totals, "sources").withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], "place"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    listed = materialize(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("most")), "weights"
    )
    rest = weighed = None
    while True:
        full = F.lit(False) if rest is None else F.col("most") * weighed <= F.col("weight") * rest
        row = listed.agg(
            F.sum(F.col("source_size") * 1.0).alias("all"),
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        now = ((row["all"] or 0.0) * share - (row["given"] or 0.0), row["open"] or 0.0)
        if now == (rest, weighed):
            break
        rest, weighed = now
    target = F.when(F.col("most") * weighed <= F.col("weight") * rest, F.col("most")).otherwise(
        F.col("weight") * rest / F.lit(weighed or 1.0)
    )
    return listed.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def with_targets(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Join each row's source; the goals are broadcast when counted to be few."""
    goals = goals.withColumnRenamed("source", "goal_source")
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("goal_source")), "left").drop("goal_source")


def copies() -> Column:
    whole = F.floor("rate")
    return (whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    text, doc_id = text_column(docs, text_col), column(docs, id_col)
    sized = materialize(
        docs.select(
            doc_id.alias("doc_id"), text_column(docs, source_col).alias("source"), word_count(text).alias("size"), draw(doc_id, text, seed).alias("draw")
        ),
        "sizes",
    )
    found = with_targets(sized, targets(sized, weights, share, most))
    return found.select("doc_id", "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """The mixed corpus: every document as often as its rate and draw say."""
    text = text_column(docs, text_col)
    sizes = docs.select(text_column(docs, source_col).alias("source"), word_count(text).alias("size"))
    rows = docs.select(
        whole_row(docs).alias("row"), text_column(docs, source_col).alias("source"), draw(column(docs, id_col), text, seed).alias("draw")
    )
    found = with_targets(rows, targets(sizes, weights, share, most)).withColumn("copies", copies()).filter("copies > 0")
    repeated = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*unpacked(repeated, "row", docs.columns))
