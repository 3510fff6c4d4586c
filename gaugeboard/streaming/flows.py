"""Streaming flows: live feed, counters, windows, anomalies, change events, ingestion.

Functions whose first argument is a stream return a stream and can be used with
any source and sink.  ``drain`` and its siblings run a stream over all input that
is available now and return the sink table.  Sinks and checkpoints live under the
shared scratch folder unless a path is given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gaugeboard.functions.kinds import number
from gaugeboard.operators.catalog import extreme_child
from gaugeboard.operators.collections import apply_changes, compact_changes
from gaugeboard.session import materialize, scratch_path
from gaugeboard.sources.folders import Folder
from gaugeboard.streaming import profiles
from gaugeboard.streaming.folded import EVERY, FoldedLog


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    file_format: str = "parquet",
    glob: str | None = None,
    files_per_batch: int | None = None,
    **options,
) -> DataFrame:
    """A stream of the files that arrive in a directory."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``ts``; zone-less times are read in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# ---- stream in, stream out -------------------------------------------------


def dedup(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once; ids are remembered for ``delay`` of event time."""
    return event_time(stream, ts, delay).dropDuplicatesWithinWatermark([key])


def running_counts(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key so far; for update mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _spanned(grouped: DataFrame) -> DataFrame:
    bounds = [F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end")]
    return grouped.select(*bounds, *[c for c in grouped.columns if c != "span"])


def tumbling(stream: DataFrame, ts: str, delay: str, size: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per fixed window."""
    timed = event_time(stream, ts, delay)
    return _spanned(timed.groupBy(F.window(ts, size).alias("span"), *keys).agg(*aggs))


def sliding(stream: DataFrame, ts: str, delay: str, size: str, step: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per overlapping window."""
    timed = event_time(stream, ts, delay)
    return _spanned(timed.groupBy(F.window(ts, size, step).alias("span"), *keys).agg(*aggs))


def sessions(stream: DataFrame, ts: str, delay: str, gap: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per burst of activity that ends with a pause of ``gap``."""
    timed = event_time(stream, ts, delay)
    return _spanned(timed.groupBy(F.session_window(ts, gap).alias("span"), *keys).agg(*aggs))


def anomalies(stream: DataFrame, key: str, value: str, history: DataFrame, z: float) -> DataFrame:
    """Rows more than ``z`` deviations from their key's mean in a static table.

    The moments are stored when the stream is defined; batches do not read the
    history again.
    """
    past = number(history, value)
    moments = history.groupBy(key).agg(F.avg(past).alias("__mean"), F.stddev_samp(past).alias("__std"))
    moments = materialize(moments, "moments")
    scored = stream.join(moments, key).withColumn("z", F.try_divide(F.col(value) - F.col("__mean"), F.col("__std")))
    return scored.where(F.abs("z") > z).drop("__mean", "__std")


# ---- running a stream over what is available -------------------------------

# A time after all others, the last year that pandas can hold; no window that ends before it stays open once it is read.
END_OF_TIME = "2262-01-01"
_CLOSED = "closed-at-the-end"


def closable(stream: DataFrame, ts: str, **values) -> tuple[DataFrame, Callable[[], None]]:
    """The stream, and a function that lets it end: it then brings a last row, at the end of time.

    Windows come out when the watermark passes their end, so the last ones of a finite input need
    such a row.  The row's own window never closes, so the row is in no result.  ``values`` are what it has in
    other columns (NULL, if not given): a join drops rows without a key before they move the watermark.
    """
    spark, folder = stream.sparkSession, scratch_path(stream.sparkSession, "closing")
    last = spark.range(1).select(*[F.lit(END_OF_TIME if f.name == ts else values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema])
    last.limit(0).write.parquet(folder)
    closing = spark.readStream.schema(last.schema).parquet(folder)
    return stream.unionByName(closing), lambda: last.write.mode("append").parquet(folder)


def drain_windows(
    stream: DataFrame, close: Callable[[], None], label: str, sink: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """All windows of a finite ``closable`` stream: first what is there, then what the end closes."""
    sink = sink or scratch_path(stream.sparkSession, label)
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{label}-checkpoint")
    drain(stream, label, sink, checkpoint)
    close()
    found = drain(stream, label, sink, checkpoint)
    Folder(stream.sparkSession, checkpoint).mark(_CLOSED)
    return found


def drain(stream: DataFrame, label: str, sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append to a Parquet table, exactly once; returns the table.

    A checkpoint that ``drain_windows`` has closed stands at the end of time and would drop every row; it is refused.
    """
    spark = stream.sparkSession
    if checkpoint and Folder(spark, checkpoint).has(_CLOSED):
        raise ValueError(f"{checkpoint} belongs to a stream that has ended")
    sink = sink or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def _drain_batches(stream: DataFrame, label: str, per_batch, log: FoldedLog, mode: str, checkpoint: str | None) -> None:
    """Write ``per_batch(rows, batch)`` of every micro-batch to the log; a repeated batch replaces itself.

    A log goes with the checkpoint it was begun with: another one would count its batches anew.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
    if log.folders() and not Folder(spark, checkpoint).has("commits"):
        raise ValueError(f"{log.log.path} was begun with another checkpoint than {checkpoint}")

    def write(rows: DataFrame, batch: int) -> None:
        # The result may read the batch more than once; do not read the source again.
        rows.persist()
        try:
            log.append(per_batch(rows, batch), batch)
        finally:
            rows.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_updates(
    stream: DataFrame, keys: Sequence[str], label: str, sink: str | None = None, checkpoint: str | None = None, every: int = EVERY
) -> DataFrame:
    """Current row per key of an update-mode aggregate.

    Batches only append the keys they changed; the newest batch wins.  Every ``every`` batches the log is
    folded to one row per key.
    """

    def newest(rows: DataFrame) -> DataFrame:
        one_key = rows.withColumn("__key", F.struct(*keys)).drop(*keys)
        latest = extreme_child(one_key, "__key", ["batch_id"])
        return latest.select("__key.*", *[c for c in latest.columns if c != "__key"]).select(*rows.columns)

    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    log = FoldedLog(stream.sparkSession, sink or scratch_path(stream.sparkSession, label), schema, newest, every)
    _drain_batches(stream, label, lambda rows, batch: rows.withColumn("batch_id", F.lit(batch).cast("long")), log, "update", checkpoint)
    return newest(log.read()).drop("batch_id")


def drain_changes(
    changes: DataFrame,
    key: str,
    seq: str,
    op: str,
    attrs: Sequence[str],
    label: str = "changes",
    sink: str | None = None,
    checkpoint: str | None = None,
    every: int = EVERY,
) -> DataFrame:
    """Apply a stream of create, update and delete events.

    Each batch is compacted to a few rows per key and stored; reading applies the compacted logs, so no
    batch rewrites the whole table.  Every ``every`` batches they are folded into one.  The changes of a key
    come in order of ``seq``, but for those of one micro-batch.
    """

    def compacted(rows: DataFrame) -> DataFrame:
        return compact_changes(rows, key, seq, op, attrs).select(key, seq, op, *attrs)

    schema = T.StructType([changes.schema[c] for c in (key, seq, op, *attrs)])
    log = FoldedLog(changes.sparkSession, sink or scratch_path(changes.sparkSession, label), schema, compacted, every)
    _drain_batches(changes, label, lambda rows, _: compacted(rows), log, "append", checkpoint)
    return apply_changes(log.read(), key, seq, op, attrs)


def drain_profiles(
    files: DataFrame, label: str = "ingest", sink: str | None = None, checkpoint: str | None = None, every: int = EVERY
) -> profiles.Profile:
    """Profile files as they arrive; every batch stores its state, and states fold into the profile of all files."""
    spark = files.sparkSession
    schema = spark.createDataFrame([], profiles.SCHEMA).schema
    log = FoldedLog(spark, sink or scratch_path(spark, label), schema, profiles.fold, every)
    _drain_batches(files, label, lambda rows, _: profiles.state(rows), log, "append", checkpoint)
    return profiles.Profile(log.read())
