"""Faults of CSV files by their place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

OPEN_QUOTE, TEXT_AFTER_QUOTE = "quote not closed", "text after a quoted field"
TOO_FEW, TOO_MANY, BAD_CELL = "too few fields", "too many fields", "bad cell"
_CORRUPT = "__corrupt"


def _kind(line: Column, schema: T.StructType, sep: str) -> Column:
    """The first fault of a record, NULL if it has none."""
    comma = re.escape(sep)
    # Well-formed quoted fields shrink to a letter; what then still begins with a quote is not well formed.
    plain = F.regexp_replace(line, f'(^|{comma})"(?:[^"]|"")*"(?={comma}|$)', "$1q")
    begins = plain.rlike(f'(^|{comma})"')
    odd = F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1
    fields = F.size(F.split(plain, comma, -1))
    # Reading every cell as its type tells whether one of them can't be.
    typed = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_csv(line, typed.simpleString()[len("struct<") : -1].replace(":", " "), {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return (
        F.when(begins & odd, OPEN_QUOTE)
        .when(begins, TEXT_AFTER_QUOTE)
        .when(fields < len(schema), TOO_FEW)
        .when(fields > len(schema), TOO_MANY)
        .when(parsed[_CORRUPT].isNotNull(), BAD_CELL)
    )


def csv_errors(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """Records that can't be read as they should: file, record, kind, text.

    Records are lines, blank ones left out; they are counted from 1 in each file, after the header.  The files are
    read once, in as many splits as they have: a split counts its records and keeps its faults, with their numbers
    within the split, and the counts of the splits before it in the file give the rest.  So lines are not
    moved, but for faulty ones, and one row per split at most a split in size.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value"
    )
    fault = F.struct("id", _kind(F.col("value"), schema, sep).alias("kind"), F.col("value").alias("text"))
    marked = lines.select("file", "start", "id", fault.alias("fault"))
    faulty = F.when(F.col("fault.kind").isNotNull(), F.col("fault"))  # collect_list leaves out NULL
    splits = marked.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.collect_list(faulty).alias("faults"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.withColumn("before", F.coalesce(before, F.lit(0))).select("file", "before", "first", F.explode("faults").alias("fault"))
    record = F.col("fault.id") - F.col("first") + F.col("before") + (0 if header else 1)
    return placed.select("file", record.alias("record"), "fault.kind", "fault.text").where("record > 0")
