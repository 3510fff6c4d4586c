"""Counters that follow their posts, and counters that end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeboard.streaming.flows import event_time


def post_counters(
    posts: DataFrame, reactions: DataFrame, post: str, ts: str, key: str, within: str, delay: str, sums: dict[str, Column] | None = None
) -> DataFrame:
    """One row per post, once no more reactions can reach it: post, ts, n and the ``sums`` of its reactions.

    A reaction counts for every post of equal ``key`` that is at most ``within`` older.  Both streams may be
    late by ``delay``; posts and reactions wait for each other in state until the watermark passes them, so the
    state is bounded by ``within`` and ``delay``.  Posts without reactions come out with n = 0.  ``sums`` are columns of ``reactions``.
    """
    added = sums or {}
    left = event_time(posts.select(F.col(post).alias("__post"), F.col(ts).alias("__at"), F.col(key).alias("__key")), "__at", delay)
    right = event_time(reactions.select(F.col(ts).alias("__then"), F.col(key).alias("__for"), *[v.alias(f"__v_{n}") for n, v in added.items()]), "__then", delay)
    near = (F.col("__then") >= F.col("__at")) & (F.col("__then") <= F.col("__at") + F.expr(f"INTERVAL {within}"))
    met = left.join(right, (F.col("__key") == F.col("__for")) & near, "leftOuter")
    counted = met.groupBy("__post", "__at").agg(F.count("__then").alias("n"), *[F.sum(f"__v_{n}").alias(n) for n in added])
    return counted.select(F.col("__post").alias(post), F.col("__at").alias(ts), "n", *added)


#: Buckets of keys; fixed for a checkpoint.
BUCKETS = 256
_HELD = "keys array<string>, n array<long>, total array<double>, first array<long>, last array<long>, timer long"


class _Counters(StatefulProcessor):
    """Counts each key's rows until none came for a while; then it says so once and forgets the key.

    Keys share the state and the timer of their bucket: the cost of a call is paid per bucket, not per key.
    """

    def __init__(self, ts: str, value: str, idle_ms: int):
        self.ts, self.value, self.idle = ts, value, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", _HELD)

    def _held(self) -> tuple[list[np.ndarray], int | None]:
        """Key, n, total, first and last of the open counters, and the time of the timer."""
        held = self.state.get() if self.state.exists() else ([], [], [], [], [], None)
        return [np.array(v, k) for v, k in zip(held, (object, np.int64, np.float64, np.int64, np.int64))], held[5]

    def _hold(self, held: list[np.ndarray], timer: int | None, fired: int | None = None) -> None:
        """Keep the open counters; the timer, unless it fired, moves to the first of their ends."""
        ends = int(self._expiry(held[4]).min()) if len(held[0]) else None
        if timer is not None and timer != ends and timer != fired:
            self.handle.deleteTimer(timer)
        if ends is None:
            self.state.clear()
            return
        if ends != timer or timer == fired:
            self.handle.registerTimer(ends)
        self.state.update((*[v.tolist() for v in held], ends))

    def _expiry(self, last: np.ndarray) -> np.ndarray:
        return last // 1000 + self.idle + 1

    @staticmethod
    def _closed(found: list[np.ndarray]) -> pd.DataFrame:
        key, n, total, first, last = found
        times = {"first": first.astype("datetime64[us]"), "last": last.astype("datetime64[us]")}
        return pd.DataFrame({"key": pd.Series(key.tolist(), dtype=object), "n": n, "total": total, **times})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        times = frame[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
        values = frame[self.value].astype(float).fillna(0.0).to_numpy()
        held, timer = self._held()
        # Open counters come as rows before the new ones of their keys.
        keys, n, total, first, last = (np.concatenate(pair) for pair in zip(held, (frame["key"].to_numpy(object), np.ones(len(frame), np.int64), values, times, times)))
        which, names = pd.factorize(keys, use_na_sentinel=False)
        order = np.lexsort((total, first, np.arange(len(keys)) >= len(held[0]), which))
        which, n, total, first, last = (v[order] for v in (which, n, total, first, last))
        new_key = np.append(True, which[1:] != which[:-1])
        open_until = pd.Series(last).groupby(which).cummax().to_numpy()
        begins = np.flatnonzero(new_key | np.append(True, first[1:] - open_until[:-1] > self.idle * 1000))
        of = which[begins]
        named = np.array([k if isinstance(k, str) else None for k in names], object)
        bursts = [named[of], np.add.reduceat(n, begins), np.add.reduceat(total, begins), np.minimum.reduceat(first, begins), np.maximum.reduceat(last, begins)]
        newest = np.append(of[1:] != of[:-1], True)
        self._hold([v[newest] for v in bursts], timer)
        if not newest.all():
            yield self._closed([v[~newest] for v in bursts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        now = expiredTimerInfo.getExpiryTimeInMs()
        # What ends before the watermark ends now, as if each key had a timer.
        ended = self._expiry(held[4]) <= max(now, timerValues.getCurrentWatermarkInMs() - 1)
        if ended.any():
            self._hold([v[~ended] for v in held], timer, fired=now)
            yield self._closed([v[ended] for v in held])

    def close(self) -> None:
        pass


def ending_counters(stream: DataFrame, key: str, ts: str, value: str, idle: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows and total of ``value`` per key and burst: key (as text), n, total, first, last; each written out once, when it ends.

    A counter ends when the watermark is ``idle`` past its last row, or when a later row of its key is.  Its state and
    timer go with it, so the state holds the keys of the last ``idle`` and ``delay`` only.  Rows of a key come in
    order of time, but for those of one micro-batch.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = event_time(stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")), "ts", delay)
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())]
        + [T.StructField(name, T.TimestampType()) for name in ("first", "last")]
    )
    counter = _Counters("ts", "value", milliseconds)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    return rows.select("*", bucket).groupBy("bucket").transformWithStateInPandas(statefulProcessor=counter, outputStructType=schema, outputMode="Append", timeMode="EventTime")
