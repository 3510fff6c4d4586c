"""CSV and JSON files in, Parquet and JSON files out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeboard.functions.kinds import TEMPORAL, kind
from gaugeboard.session import materialize

CORRUPT = "_corrupt_record"
PREVIEW_ROWS = 100


def _reader(spark: SparkSession, mode: str, sep: str, header: bool = True):
    return spark.read.option("header", header).option("mode", mode).option("sep", sep)


def infer_csv_schema(spark: SparkSession, path: str, sep: str = ",", dates_as_strings: bool = False) -> T.StructType:
    """Column names and types from a pass over the files.

    Large inputs should pass a known schema to the readers and skip this pass.
    """
    schema = _reader(spark, "PERMISSIVE", sep).option("inferSchema", True).csv(path).schema
    if not dates_as_strings:
        return schema
    return T.StructType(
        [T.StructField(f.name, T.StringType() if kind(f.dataType) == TEMPORAL else f.dataType, True) for f in schema.fields]
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    on_error: str = "null",
    sep: str = ",",
    dates_as_strings: bool = False,
) -> DataFrame:
    """CSV with a header.  A bad cell becomes NULL, or fails with ``on_error='fail'``."""
    modes = {"null": "PERMISSIVE", "fail": "FAILFAST"}
    schema = schema or infer_csv_schema(spark, path, sep, dates_as_strings)
    return _reader(spark, modes[on_error], sep).schema(schema).csv(path)


def csv_preview(spark: SparkSession, path: str, n: int = PREVIEW_ROWS, sep: str = ",") -> DataFrame:
    """The first ``n`` rows as text, blank lines skipped: the heads of the files in the order of their names.

    Reads no further than it needs; at most ``n`` rows pass through the driver.
    """
    scan, rows = _reader(spark, "PERMISSIVE", sep).csv(path), []
    for file in sorted(scan.inputFiles()):
        if len(rows) >= n:
            break
        rows += _reader(spark, "PERMISSIVE", sep).schema(scan.schema).csv(file).head(n - len(rows))
    return spark.createDataFrame(rows, scan.schema)


def csv_audit(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True
) -> DataFrame:
    """Per file: rows, good rows, bad rows (wrong field count or a bad cell), filled cells."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    parsed = (
        _reader(spark, "PERMISSIVE", sep, header)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(with_corrupt)
        .csv(path)
    )
    # Counting the filled cells makes the parser check every declared column.
    filled = [F.col(f"`{n}`").isNotNull().cast("bigint") for n in schema.names]
    return parsed.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(CORRUPT).isNull()).alias("good_rows"),
        F.count(CORRUPT).alias("bad_rows"),
        F.sum(sum(filled[1:], filled[0])).alias("filled_cells"),
    )


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Snappy Parquet."""
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "error") -> None:
    """A table bucketed and sorted by key: joins and grouping on it need no shuffle.

    It stands in for the secondary index a relational store keeps on a foreign key.
    """
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; columns that are NULL are written too."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def records_json(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def map_rows(
    df: DataFrame,
    step: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    complete: Callable[[DataFrame], object] | None = None,
) -> DataFrame:
    """Run a callback on each Arrow batch of rows, on the executors.

    With ``complete``, the results are stored first, so that every row has been through ``step`` once, and
    ``complete`` is called with them; it is not called when a step fails.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield step(frame)

    out = df.mapInPandas(batches, schema)
    if complete is not None:
        out = materialize(out, "callback")
        complete(out)
    return out
