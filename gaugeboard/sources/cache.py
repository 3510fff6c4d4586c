"""Stored profile results: read if they are of the present input, else compute and store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from gaugeboard.sources.folders import Folder


def input_version(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files at or below the paths."""
    found = [entry for path in paths for entry in Folder(spark, path).fingerprint()]
    return hashlib.sha256(repr(found).encode()).hexdigest()[:32]


def cached_result(
    spark: SparkSession, path: str, dataset: str, style: str, schema, compute: Callable[[], DataFrame], version: str = "0"
) -> DataFrame:
    """Rows stored for (dataset, style, version), computed and stored on first use.

    Take ``version`` from ``input_version`` and a changed input gets a new result, which replaces those of other
    versions.  A result without rows is stored as such; one that was not written to its end does not count.
    """
    results = Folder(spark, path).child(f"dataset={quote(dataset, safe='')}").child(f"style={quote(style, safe='')}")
    folder = results.child(f"version={quote(version, safe='')}")
    if not folder.has("_SUCCESS"):
        compute().write.mode("overwrite").parquet(folder.path)
        for name in results.names():
            if f"{results.path}/{name}" != folder.path:
                results.delete(name)
    return spark.read.schema(schema).parquet(folder.path)
