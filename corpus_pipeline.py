"""From raw documents to a training mix.

Rejects documents of low quality, keeps one of each group of near copies, cuts passages that an
earlier document has, drops documents contaminated by the benchmark and repeats or thins out
sources to their weights.  Every stage takes whole rows and, but for the repeats of the last, returns
rows of the same columns; the text (and ``n_chars``) changes only where a passage is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeboard.llm import classify, decontaminate, mixing, simhash, substrings
from gaugeboard.session import configure, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of these documents."""
    return classify.accepted(docs, _table(configure(spark), sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of linked fingerprints."""
    configure(spark)
    return simhash.without_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of smaller id has; a text may become empty."""
    configure(spark)
    return substrings.without_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    return decontaminate.without_contaminated(docs, _table(configure(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, as often as their source's target asks for."""
    configure(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_copies),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
]

#: The classifier is trained by stochastic gradient descent, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
