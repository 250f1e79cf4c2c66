"""Generated points and samples that depend on ids alone (OP-40, 41, 77, 81, 83)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.geo import EARTH_KM, annulus_point, clamp_lat, wrap_lon
from ..schema import Axis
from ..sources.tables import scratch, stage
from .raster import is_ocean

P = 2147483647
#: The largest bitmap of ocean cells that is sent to tasks: a globe of half-minute cells is 116 MB, of one-minute cells 29 MB. Rows of it that are packed at a time.
MOST_BITMAP, ROWS_A_BLOCK = 32 << 20, 64


def uniform(id_: Column, attempt: Column, salt: int) -> Column:
    """A number in [0, 1) from an id, a counter and a salt, in exact 64-bit arithmetic that SQL engines share."""
    a = F.pmod((F.pmod(id_.cast("long"), F.lit(P)) + 1) * 48271 + attempt * 1000003 + salt, F.lit(P))  # any 64-bit id
    b = F.pmod(a * a + a * 69621 + 12345, F.lit(P))
    c = F.pmod(b * 16807 + attempt * 7919 + salt, F.lit(P))
    return F.pmod(c * c + c * 39373 + 7, F.lit(P)) / float(P)


def uniform_sql(id_: str, attempt: str, salt: int) -> str:
    """The same in SQL."""
    a = f"((({id_})%{P}+1)*48271+({attempt})*1000003+{salt})%{P}"
    b = f"(({a})*({a})+({a})*69621+12345)%{P}"
    c = f"(({b})*16807+({attempt})*7919+{salt})%{P}"
    return f"((({c})*({c})+({c})*39373+7)%{P})/{P}.0"


def ring_points(points: DataFrame, attempts: range, inner_km: float = 15.0, outer_km: float = 300.0, seed: int = 42) -> DataFrame:
    """OP-40, 42: one candidate an attempt for each point (id, Lat, Lon and more), as Lat and Lon; rounded to five places."""
    tries = F.sequence(F.lit(attempts.start).cast("long"), F.lit(attempts.stop - 1).cast("long"))
    # a step of columns for each, so that no number is drawn twice
    drawn = points.withColumn("attempt", F.explode(tries)).withColumns(
        {"_u": uniform(F.col("id"), F.col("attempt"), seed), "_v": uniform(F.col("id"), F.col("attempt"), seed + 1)}
    )
    lat, lon = annulus_point(F.col("Lat"), F.col("Lon"), inner_km, outer_km, F.col("_u"), F.col("_v"))
    placed = drawn.withColumns({"_lat": lat, "_lon": lon})
    return placed.withColumns(
        {"Lat": F.round(clamp_lat(F.col("_lat")), 5), "Lon": F.round(wrap_lon(F.col("_lon")), 5)}
    ).drop("_u", "_v", "_lat", "_lon")


def uniform_array(id_: np.ndarray, attempt: np.ndarray | int, salt: int) -> np.ndarray:
    """``uniform`` over arrays."""
    a = ((id_ % P + 1) * 48271 + attempt * 1000003 + salt) % P
    b = (a * a + a * 69621 + 12345) % P
    c = (b * 16807 + attempt * 7919 + salt) % P
    return (c * c + c * 39373 + 7) % P / P


def ocean_bitmap(altitude: DataFrame, lat: Axis, lon: Axis, most_bytes: int = MOST_BITMAP) -> np.ndarray | None:
    """A bit for each cell, set below sea level, row by row; None where it would be larger than ``most_bytes``."""
    width = -(-lon.n // 8)
    if lat.n * width > most_bytes:
        return None

    def pack(t: pa.Table) -> pa.Table:
        first = t.column("block")[0].as_py() * ROWS_A_BLOCK
        bits = np.zeros((ROWS_A_BLOCK, width * 8), bool)
        bits[t.column("lat_idx").to_numpy() - first, t.column("lon_idx").to_numpy()] = True
        return pa.table({"block": t.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    here = F.col("lat_idx").between(0, lat.n - 1) & F.col("lon_idx").between(0, lon.n - 1)
    ocean = altitude.where(here & (F.col("value") < 0)).select("lat_idx", "lon_idx", F.floor(F.col("lat_idx") / ROWS_A_BLOCK).cast("int").alias("block"))
    out = np.zeros((-(-lat.n // ROWS_A_BLOCK) * ROWS_A_BLOCK, width), np.uint8)
    for r in ocean.groupBy("block").applyInArrow(pack, "block int, bits binary").toLocalIterator():
        at = r["block"] * ROWS_A_BLOCK
        out[at : at + ROWS_A_BLOCK] = np.frombuffer(r["bits"], np.uint8).reshape(ROWS_A_BLOCK, width)
    return out[: lat.n]


def waves(each: int, attempts: int) -> list[range]:
    """Ranges of attempts, each as long as all before it, so that no more than twice those needed are made."""
    out, at = [], 0
    while at < attempts:
        out.append(range(at, min(attempts, max(each, 2 * at))))
        at = out[-1].stop
    return out


def pseudo_absences(
    presences: DataFrame, altitude: DataFrame, lat: Axis, lon: Axis, each: int = 4, attempts: int = 201, seed: int = 42, inner_km: float = 15.0,
    outer_km: float = 300.0, most_bytes: int = MOST_BITMAP
) -> DataFrame:
    """OP-41: up to ``each`` ocean points around each presence, the first that qualify of ``attempts``.

    The ocean is a bitmap of the raster's cells, whose size follows from the axes; up to ``most_bytes`` it is sent to the tasks, which make
    attempts in waves that double, for the points that are still short alone: no exchange, no join. Beyond, waves of candidates meet the raster, each written. The result is
    the same. A point that stays short has fewer rows; one without an id or a place has none. Columns of ``presences`` are kept, Presence is 0, and
    ``attempt`` says which attempt it was.
    """
    bits = ocean_bitmap(altitude, lat, lon, most_bytes)
    if bits is None:
        return _by_joins(presences, altitude, lat, lon, each, attempts, seed, inner_km, outer_km)
    shared = presences.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([f for f in presences.schema.fields if f.name not in ("attempt", "Presence")] + [T.StructField("attempt", T.LongType()), T.StructField("Presence", T.IntegerType())])
    plain = presences.drop("attempt", "Presence").withColumns({c: F.col(c).cast(presences.schema[c].dataType) for c in ("Lat", "Lon")})

    def run(batches):
        ocean = shared.value
        for b in batches:
            ids, y0, x0 = (b.column(c) for c in ("id", "Lat", "Lon"))
            whole = np.flatnonzero(~(np.asarray(ids.is_null()) | np.asarray(y0.is_null()) | np.asarray(x0.is_null())))
            ids, y0, x0 = (c.take(pa.array(whole)).to_numpy(zero_copy_only=False) for c in (ids, y0, x0))
            had, found = np.zeros(len(whole), np.int64), []
            for tries in waves(each, attempts):
                short = np.flatnonzero(had < each)
                if not len(short):
                    break
                who, attempt = np.repeat(short, len(tries)), np.tile(np.arange(tries.start, tries.stop), len(short))
                y, x = _ring(ids[who].astype(np.int64), attempt, y0[who], x0[who], inner_km, outer_km, seed)
                i, j = (np.clip(np.floor((v - a.start) / a.step + 0.5), 0, a.n - 1).astype(np.int64) for v, a in ((y, lat), (x, lon)))
                hit = (ocean[i, j >> 3] >> (7 - (j & 7)).astype(np.uint8)) & 1 == 1
                n = hit.reshape(len(short), -1).cumsum(1).ravel() + had[who]
                take = hit & (n <= each)
                found.append((whole[who[take]], y[take], x[take], attempt[take]))
                had += np.bincount(who[take], minlength=len(had))
            row, y, x, attempt = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            made = {"Lat": y, "Lon": x}
            columns = [pa.array(made[n], b.schema.field(n).type) if n in made else b.column(n).take(pa.array(row)) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(attempt.astype(np.int64)), pa.array(np.zeros(len(row), np.int32))], names=[*b.schema.names, "attempt", "Presence"])

    return plain.mapInArrow(run, schema)


def _ring(ids: np.ndarray, attempt: np.ndarray, lat: np.ndarray, lon: np.ndarray, inner_km: float, outer_km: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``ring_points`` over arrays."""
    km = np.sqrt(uniform_array(ids, attempt, seed) * (outer_km**2 - inner_km**2) + inner_km**2)
    bearing, d, a = uniform_array(ids, attempt, seed + 1) * (2 * math.pi), km / EARTH_KM, np.radians(lat)
    to = np.arcsin(np.sin(a) * np.cos(d) + np.cos(a) * np.sin(d) * np.cos(bearing))
    east = np.arctan2(np.sin(bearing) * np.sin(d) * np.cos(a), np.cos(d) - np.sin(a) * np.sin(to))
    return np.round(np.clip(np.degrees(to), -90, 90), 5), np.round((lon + np.degrees(east) + 180) % 360 - 180, 5)


def _by_joins(presences: DataFrame, altitude: DataFrame, lat: Axis, lon: Axis, each: int, attempts: int, seed: int, inner_km: float, outer_km: float) -> DataFrame:
    first_n, spark = W.partitionBy("id").orderBy("attempt"), presences.sparkSession
    short, done = presences.where(F.col("id").isNotNull()).withColumn("_had", F.lit(0).cast("long")), None
    for tries in waves(max(each, 16), attempts):  # longer first waves, as each is an exchange
        ocean = is_ocean(ring_points(short, tries, inner_km, outer_km, seed), altitude, lat, lon)
        got = ocean.withColumn("_n", F.row_number().over(first_n)).where(F.col("_n") + F.col("_had") <= each).drop("_n")
        got = stage(got, scratch(spark, "wave"))
        done = got if done is None else done.unionByName(got)
        now = done.groupBy("id").agg(F.count("*").alias("_had"))
        short = stage(presences.where(F.col("id").isNotNull()).join(now, "id", "left").withColumn("_had", F.coalesce("_had", F.lit(0).cast("long"))).where(F.col("_had") < each), scratch(spark, "short"))
        if short.isEmpty():
            break
    return done.drop("_had").withColumn("Presence", F.lit(0))


def with_absences(presences: DataFrame, absences: DataFrame) -> DataFrame:
    """OP-77, 83: both, missing columns NULL. Their order, by date and presences first, is put on where they are written (``in_order``)."""
    return presences.unionByName(absences, allowMissingColumns=True)


def in_order(df: DataFrame) -> DataFrame:
    """OP-83: by date, presences first; for the last step, as every join takes the order away."""
    return df.orderBy(F.asc("Date"), F.desc("Presence"))


def fixed_sample(df: DataFrame, n: int, id_: str = "id", seed: int = 42) -> DataFrame:
    """OP-81: n rows in the order of a hash of their ids; the same rows however the data is partitioned."""
    return df.withColumn("_order", uniform(F.col(id_), F.lit(0), seed)).orderBy("_order", id_).limit(n).drop("_order")
