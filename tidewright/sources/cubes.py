"""Rasters: a Python data source over an opener of slabs, in bands and with retries (OP-03 to 06), and Parquet grids.

A raster in long form has a row for each cell, also where its value is missing.
"""

from __future__ import annotations

import datetime
import importlib
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schema import GRID

#: Cells of an Arrow batch.
BATCH_CELLS = 1 << 16


def with_retries(fetch: Callable[[], list], tries: int = 3, wait_s: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> list | None:
    """OP-06: waits wait_s * 2**attempt between tries; None after the last."""
    for attempt in range(tries):
        try:
            return fetch()
        except Exception:  # whatever a remote server's client raises
            if attempt + 1 < tries:
                sleep(wait_s * 2**attempt)
    return None


@dataclass
class Plane:
    """A slab of one time and depth as an opener gives it: the numbers and coordinates of its rows and columns, and values (NaN is missing)."""

    time: datetime.datetime | None
    depth: int | None
    lat_idx: np.ndarray
    lon_idx: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    values: np.ndarray


class _Part(InputPartition):
    def __init__(self, key: str, box: dict[str, tuple[float, float]], below: float):
        super().__init__(key)
        self.key, self.box, self.below = key, box, below


def _narrower(a: tuple, b: tuple) -> tuple:
    return max(a[0], b[0]), min(a[1], b[1])


class CubeReader(DataSourceReader):
    """Reads one band of latitude of a key in each task, in Arrow batches.

    Ranges of lat and lon that the query asks for, and a key's own box, go to the opener as ``box``. A key whose time is known and isn't
    asked for has no task. Rows that Spark asks for are filtered by Spark again.
    """

    def __init__(self, options: dict[str, str]):
        module, _, name = options["opener"].partition(":")
        self.open = getattr(importlib.import_module(module), name)
        self.keys = [(k["key"], k.get("time"), {n: tuple(r) for n, r in (k.get("box") or {}).items()}) for k in json.loads(options["keys"])]
        self.tries, self.wait_s, self.band = int(options.get("tries", 3)), float(options.get("wait_s", 5)), float(options.get("band", 15))
        self.box: dict[str, tuple[float, float]] = {}
        self.times: tuple[float, float] = (-math.inf, math.inf)
        self.named: set[float] | None = None

    def pushFilters(self, filters):
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            low, high = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual), isinstance(f, EqualTo | LessThan | LessThanOrEqual)
            if name in ("lat", "lon") and isinstance(value, int | float) and (low or high):
                self.box[name] = _narrower(self.box.get(name, _ALL), (value if low else -math.inf, value if high else math.inf))
            elif name == "time" and isinstance(value, datetime.datetime) and (low or high):
                at = _seconds(value)
                self.times = _narrower(self.times, (at if low else -math.inf, at if high else math.inf))
            elif name == "time" and isinstance(f, In) and all(isinstance(v, datetime.datetime) for v in f.value):
                asked = {_seconds(v) for v in f.value}
                self.named = asked if self.named is None else self.named & asked
            yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for key, time_, own in self.keys:
            at = None if time_ is None else _seconds(datetime.datetime.fromisoformat(time_))
            if at is not None and not (self.times[0] <= at <= self.times[1] and (self.named is None or at in self.named)):
                continue
            box = {n: _narrower(self.box.get(n, _ALL), own.get(n, _ALL)) for n in {*self.box, *own}}
            low, high = _narrower(box.get("lat", _ALL), (-90.0, 90.0))
            if any(r[0] > r[1] for r in box.values()) or low > high:
                continue
            cuts = [low, *(x for k in range(1, math.ceil(180 / self.band)) if low < (x := -90 + k * self.band) <= high), high]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                last = b == high
                out.append(_Part(key, box | {"lat": (a, b)}, math.inf if last else b))
                if last:
                    break
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        # a slab that can't be had gives no cells, so that samples of it are NULL and the job goes on
        for plane in with_retries(lambda: list(self.open(partition.key, partition.box)), self.tries, self.wait_s) or []:
            yield from batches_of(plane, partition.below)


_ALL = (-math.inf, math.inf)


def _seconds(at: datetime.datetime) -> float:
    return (at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)).timestamp()


def batches_of(plane: Plane, below: float = math.inf) -> Iterator[pa.RecordBatch]:
    """The cells of a plane south of ``below`` in GRID's order, some rows at a time."""
    many = max(1, BATCH_CELLS // max(1, len(plane.lon)))
    rows = np.flatnonzero(plane.lat < below)
    at = None if plane.time is None else int(_seconds(plane.time) * 1e6)
    for k in range(0, len(rows), many):
        r = rows[k : k + many]
        n = len(r) * len(plane.lon)
        values = plane.values[r].astype(float).ravel()
        columns = [
            pa.array(np.full(n, at), pa.timestamp("us", "UTC")) if at is not None else pa.nulls(n, pa.timestamp("us", "UTC")),
            pa.array(np.full(n, plane.depth, np.int32)) if plane.depth is not None else pa.nulls(n, pa.int32()),
            pa.array(np.repeat(plane.lat_idx[r], len(plane.lon)).astype(np.int32)), pa.array(np.tile(plane.lon_idx, len(r)).astype(np.int32)),
            pa.array(np.repeat(plane.lat[r], len(plane.lon)).astype(float)), pa.array(np.tile(plane.lon, len(r)).astype(float)),
            pa.array(values, mask=np.isnan(values))
        ]
        yield pa.RecordBatch.from_arrays(columns, names=GRID.names)


class CubeSource(DataSource):
    """Format ``cube``: option ``opener`` names a function ``module:function`` that gives the planes of (key, box); ``keys`` is JSON, see ``read_cube``.

    ``box`` maps lat and lon to closed ranges, lat always: the band of the task.
    """

    @classmethod
    def name(cls) -> str:
        return "cube"

    def schema(self):
        return GRID

    def reader(self, schema) -> DataSourceReader:
        return CubeReader(self.options)


@dataclass
class Key:
    """What an opener opens; ``time``, where it is known, lets a query's times rule the key out, ``box`` bounds what is read of it."""

    key: str
    time: datetime.datetime | None = None
    box: dict[str, tuple[float, float]] | None = None


def read_cube(spark: SparkSession, opener: str, keys: list[str | Key], **options: str) -> DataFrame:
    """OP-03: keys fetched by the executors, each in bands of ``band`` degrees of latitude (15), a task for a band of a key.

    The planes of a band are held by its task; the cells leave it in batches of bounded size.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CubeSource)
    plain = [k if isinstance(k, Key) else Key(k) for k in keys]
    coded = json.dumps([{"key": k.key, "time": k.time and k.time.isoformat(), "box": k.box} for k in plain])
    return spark.read.format("cube").options(opener=opener, keys=coded, **options).load()


def read_around(
    spark: SparkSession, opener: str, keys: dict[datetime.datetime, str], points: DataFrame, buffer: float = 0.5, time_: str = "time", **options: str
) -> DataFrame:
    """OP-04, 37, 38: of each key the box around the points of its time, widened; keys that no point asks for aren't opened.

    The boxes, a row for each time of the points, come to the driver, which plans the tasks. ``keys`` names the key of each time, in UTC.
    """
    ends = [F.min("Lat"), F.max("Lat"), F.min("Lon"), F.max("Lon")]
    boxes = points.where(F.col(time_).isNotNull() & F.col("Lat").isNotNull() & F.col("Lon").isNotNull()).groupBy(F.unix_micros(time_).alias("t")).agg(
        *[e.alias(n) for e, n in zip(ends, ("a", "b", "c", "d"), strict=True)]
    )
    asked = {r["t"]: r for r in boxes.toLocalIterator()}
    at = {int(_seconds(t) * 1e6): (t, k) for t, k in keys.items()}
    wide = lambda lo, hi: (lo - buffer, hi + buffer)
    chosen = [Key(k, t, {"lat": wide(asked[us]["a"], asked[us]["b"]), "lon": wide(asked[us]["c"], asked[us]["d"])}) for us, (t, k) in at.items() if us in asked]
    return read_cube(spark, opener, chosen, **options) if chosen else spark.createDataFrame([], GRID)


def slab(grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float], time_: Column | None = None) -> DataFrame:
    """OP-04: the cells in closed ranges, of one time; on Parquet the predicates reach the scan."""
    out = grid.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    return out if time_ is None else out.where(F.col("time") == time_)


def depth_slice(grid: DataFrame, index: int = 0) -> DataFrame:
    """OP-05."""
    return grid.where(F.col("depth_idx") == index).drop("depth_idx")
