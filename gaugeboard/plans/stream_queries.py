"""Streaming flows over the files of the test tables, run until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeboard.plans.catalog_queries import CHANGES_SQL, event_changes
from gaugeboard.plans.profile_queries import rounded
from gaugeboard.plans.registry import Tables, query
from gaugeboard.session import scratch_path
from gaugeboard.streaming import counters, flows

DELAY = "10 minutes"


def _events(t: Tables):
    return flows.read_files(t.spark, t.folder, t.events.schema, glob="events.parquet")


def _naive(df, *names: str):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("stream_dedup", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_dedup(t: Tables):
    """Every event is delivered twice."""
    both = _events(t).unionByName(_events(t)).select("event_id", "ts", "user_id", "event_type", "value")
    return _naive(flows.drain(flows.dedup(both, "event_id", "ts", "1 hour"), "dedup"), "ts")


@query("stream_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(t: Tables):
    keys = ["user_id", "event_type"]
    return flows.drain_updates(flows.running_counts(_events(t), keys), keys, "counts")


_AGGS_SQL = "count(*) AS n, round(sum(value), 4) AS total"


def _aggs():
    return [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]


def _windows(t: Tables, label: str, spans):
    """All windows of the events, the last ones included."""
    events, close = flows.closable(_events(t), "ts")
    found = flows.drain_windows(spans(events), close, label)
    return rounded(_naive(found, "window_start", "window_end"), 4)


@query(
    "stream_tumbling",
    f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, event_type, {_AGGS_SQL}
        FROM events GROUP BY 1, 2, 3""",
)
def stream_tumbling(t: Tables):
    return _windows(t, "tumbling", lambda events: flows.tumbling(events, "ts", DELAY, "1 day", ["event_type"], _aggs()))


@query(
    "stream_sliding",
    f"""SELECT date_trunc('hour', ts)::TIMESTAMP - s.h * INTERVAL 1 HOUR AS window_start,
               date_trunc('hour', ts)::TIMESTAMP - s.h * INTERVAL 1 HOUR + INTERVAL 3 HOUR AS window_end, event_type, {_AGGS_SQL}
        FROM events CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(3)) s GROUP BY 1, 2, 3""",
)
def stream_sliding(t: Tables):
    return _windows(t, "sliding", lambda events: flows.sliding(events, "ts", DELAY, "3 hours", "1 hour", ["event_type"], _aggs()))


@query(
    "stream_session",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
             s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
        SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, {_AGGS_SQL}
        FROM s GROUP BY user_id, sid""",
)
def stream_session(t: Tables):
    return _windows(t, "sessions", lambda events: flows.sessions(events, "ts", DELAY, "30 minutes", ["user_id"], _aggs()))


@query(
    "stream_anomaly",
    """WITH m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY 1)
       SELECT event_id, user_id, e.event_type AS event_type, value, round((value - mean) / std, 6) AS z
       FROM events e JOIN m ON e.event_type = m.event_type WHERE abs((value - mean) / std) > 3""",
)
def stream_anomaly(t: Tables):
    stream = _events(t).select("event_id", "user_id", "event_type", "value")
    return rounded(flows.drain(flows.anomalies(stream, "event_type", "value", t.events, 3.0), "anomaly"), only=("z",))


def _in_files(t: Tables, rows, order: str, files: int, label: str, **options):
    """A stream of the rows in files by rising ``order``, a micro-batch each."""
    path = scratch_path(t.spark, label)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = (high - low) / files
    for i in range(files):
        part = rows.where((F.col(order) >= low + step * i) & ((F.col(order) < low + step * (i + 1)) if i < files - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    return flows.read_files(t.spark, path, rows.schema, files_per_batch=1, **options)


@query("stream_apply_changes", CHANGES_SQL)
def stream_apply_changes(t: Tables):
    """Changes that arrive in six micro-batches, folded after every second one."""
    changes = _in_files(t, event_changes(t.events), "seq", 6, "change-files")
    return flows.drain_changes(changes, "user_id", "seq", "op", ["amount", "score"], every=2)


@query(
    "stream_post_counters",
    """SELECT p.event_id AS event_id, p.ts AS ts, count(r.ts) AS n, round(sum(r.value), 4) AS total
       FROM events p LEFT JOIN events r ON r.event_type <> 'view' AND r.user_id = p.user_id AND r.ts BETWEEN p.ts AND p.ts + INTERVAL 2 HOUR
       WHERE p.event_type = 'view' GROUP BY 1, 2""",
)
def stream_post_counters(t: Tables):
    """Views as posts, the other events of a user as reactions, which arrive up to ten days late."""
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    late = events.where("event_type <> 'view'").withColumn("arrival", F.col("ts") + F.expr("INTERVAL 9 DAYS"))
    posts, close_posts = flows.closable(_in_files(t, events.where("event_type = 'view'"), "ts", 3, "posts").drop("event_type"), "ts", user_id=-1)
    reactions, close_reactions = flows.closable(_in_files(t, late, "arrival", 3, "reactions").drop("event_type", "arrival"), "ts", user_id=-1)
    counted = counters.post_counters(posts, reactions, "event_id", "ts", "user_id", "2 HOURS", "11 days", {"total": F.col("value")})

    def close():
        close_posts()
        close_reactions()

    found = flows.drain_windows(counted, close, "post-counters")
    return rounded(_naive(found, "ts"), 4, ("total",))


@query(
    "stream_ending_counters",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
       SELECT user_id::VARCHAR AS "key", count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, burst""",
)
def stream_ending_counters(t: Tables):
    """Events per user until there is a pause of half a day, over three micro-batches."""
    stream, close = flows.closable(_in_files(t, t.events.select("ts", "user_id", "value"), "ts", 3, "bursts"), "ts")
    # The closing row's own counter stays open, so it is in no result.
    found = flows.drain_windows(counters.ending_counters(stream, "user_id", "ts", "value", "12 hours", DELAY), close, "ending")
    return rounded(_naive(found, "first", "last"), 4, ("total",))


_INGESTED = ["event_id", "user_id", "value"]


def _arrivals(t: Tables) -> flows.profiles.Profile:
    """CSV files that arrive in four micro-batches, profiled as they come."""
    rows = t.events.select("event_id", "event_type", "user_id", "value")
    path = scratch_path(t.spark, "arrivals")
    rows.repartition(8).write.option("header", True).csv(path)
    arriving = flows.read_files(t.spark, path, rows.schema, "csv", files_per_batch=2, header=True)
    return flows.drain_profiles(arriving, every=2)


@query(
    "stream_ingest_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
            CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text, true AS median_in_bound FROM events"""
        for c in _INGESTED
    )
    + " UNION ALL SELECT 'event_type', count(event_type), NULL, NULL, NULL, NULL, min(event_type), max(event_type), NULL FROM events",
)
def stream_ingest_profile(t: Tables):
    """The summary, and whether each median's place among all values is within the stated bound."""
    summary = _arrivals(t).summary()
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in _INGESTED]))
    places = t.events.select(values).join(F.broadcast(summary.select("column", "median")), "column").where("v IS NOT NULL").groupBy("column").agg(  # a row per column
        F.avg(F.when(F.col("v") < F.col("median"), 1).otherwise(0)).alias("below"), F.avg(F.when(F.col("v") <= F.col("median"), 1).otherwise(0)).alias("upto")
    )
    bound = flows.profiles.MEDIAN_BOUND
    near = (F.col("below") <= 0.5 + bound) & (F.col("upto") >= 0.5 - bound)
    return rounded(summary.join(places.select("column", near.alias("median_in_bound")), "column", "left").drop("median"))


@query(
    "stream_ingest_categories",
    """SELECT 'event_type' AS "column", event_type AS category, count(*) AS "count" FROM events WHERE event_type IS NOT NULL
       GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 10""",
)
def stream_ingest_categories(t: Tables):
    return _arrivals(t).categories()


@query(
    "stream_ingest_correlations",
    " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM events" for a in _INGESTED for b in _INGESTED),
)
def stream_ingest_correlations(t: Tables):
    return rounded(_arrivals(t).correlations())
