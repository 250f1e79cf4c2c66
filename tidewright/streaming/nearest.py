"""The nearest time of a stream of slices for each sighting of a stream (OP-32), with keyed state and event-time timers.

A sighting can be settled only when the slices after it have come, so it waits. Time is cut into buckets as wide as the tolerance: a
sighting belongs to its bucket, a slice to its own and the two beside it, so that the slices a sighting may take are all in its bucket's state. A
timer at the end of the last moment that matters to a bucket settles its sightings once the watermark has passed it, and clears the state. Slices and
sightings later than the watermark allows are left out by Spark, which counts them (``late_rows``).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MOMENT = T.StructType([T.StructField("at", T.LongType())])
_SIGHTING = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType())])
_OUT = "id long, key timestamp, time timestamp"


class NearestSlice(StatefulProcessor):
    """State of a bucket: the moments of its slices and the sightings that wait, in microseconds."""

    def __init__(self, tolerance_us: int):
        self.tolerance_us = tolerance_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices, self.waiting = handle.getListState("slices", _MOMENT), handle.getListState("waiting", _SIGHTING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            at = part["at_us"].astype("int64")
            slices, own = sorted(set(at[part["is_slice"]])), part[~part["is_slice"]]
            if slices:
                self.slices.appendList([(int(t),) for t in slices])
            if len(own):
                self.waiting.appendList([(int(i), int(t)) for i, t in zip(own["id"], own["at_us"], strict=True)])
        # no slice that matters to the bucket is later than its end and the tolerance
        self.handle.registerTimer(-(-(int(key[0]) + 2) * self.tolerance_us // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted({t for (t,) in self.slices.get()})
        rows = []
        for i, at in self.waiting.get():
            k = bisect.bisect_left(times, at)
            near = [t for t in times[max(0, k - 1) : k + 1] if abs(t - at) <= self.tolerance_us]
            best = min(near, key=lambda t: (abs(t - at), -t), default=None)  # the later of two
            rows.append((i, at, best))
        self.slices.clear()
        self.waiting.clear()
        if rows:
            out = pd.DataFrame(rows, columns=["id", "key", "time"])
            yield pd.DataFrame({"id": out["id"], "key": pd.to_datetime(out["key"], unit="us"), "time": pd.to_datetime(out["time"].astype("Int64"), unit="us")})

    def close(self) -> None:
        pass


def nearest_time_stream(points: DataFrame, slices: DataFrame, tolerance_s: float, late: str, id_: str = "id", key: str = "key", time: str = "time") -> DataFrame:
    """(id, key, time) of each sighting, in append mode: the nearest slice within the tolerance, the later of two; NULL without one.

    ``late`` is how much later than the latest row a row may come. Sightings without an id or a key are left out. The session must keep its state in
    RocksDB (``PROVIDER``).
    """
    us = int(tolerance_s * 1_000_000)
    plain = lambda df, i, at, is_slice: df.where(F.col(at).isNotNull()).select(i, F.col(at).cast("timestamp").alias("at"), F.lit(is_slice).alias("is_slice"))
    both = plain(points.where(F.col(id_).isNotNull()), F.col(id_).cast("long").alias("id"), key, False).unionByName(plain(slices, F.lit(None).cast("long").alias("id"), time, True))
    marked = both.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    home = F.floor(F.col("at_us") / us)
    beside = F.when(F.col("is_slice"), F.array(home - 1, home, home + 1)).otherwise(F.array(home))
    return marked.withColumn("bucket", F.explode(beside)).groupBy("bucket").transformWithStateInPandas(NearestSlice(us), _OUT, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late, as far as the query's progress is kept; a slice counts for each of its buckets."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
