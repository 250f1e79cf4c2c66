"""Raster sampling and gradients (OP-30, 32 to 34, 37, 38, 44, 67)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import KM_PER_DEGREE
from ..schema import Axis
from .ordering import around

#: Cells on a side of the tiles that neighbours are taken in.
TILE = 256
#: Width of the finest tiles that boxes meet cells in, degrees, and the number of levels, each of twice the width: the coarsest tiles are wider than the globe.
FINEST_DEG, LEVELS = 1 / 16, 14


def nearest_index(x: Column, axis: Axis) -> Column:
    """The cell of a regular ascending axis nearest to x, the larger coordinate of two; x beyond an end gets the end."""
    i = F.floor((x - axis.start) / axis.step + 0.5)
    # least and greatest pass over NULL
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(axis.n - 1), i)).cast("int"))


def nearest_time(points: DataFrame, times: DataFrame, key: str = "key", time: str = "time", tolerance_s: float | None = None, few: bool = False) -> DataFrame:
    """OP-32: ``points`` with the nearest of ``times`` as ``time``, the later of two; NULL beyond the tolerance.

    Only distinct keys and times meet: in ranges of time, each key between the last time before it and the first after
    it, carried in from other ranges where its own has none. The work is linear in keys and times. With ``few`` keys, such as the days of a calendar,
    what was found is sent to the points, which then aren't moved.
    """
    keys = points.select(F.col(key).alias("_x"), F.lit(None).cast("timestamp").alias("_t")).where(F.col(key).isNotNull())
    axis = times.select(F.col(time).alias("_x"), F.col(time).alias("_t")).where(F.col(time).isNotNull())
    both = keys.unionByName(axis).groupBy("_x").agg(F.max("_t").alias("_t"))
    put = around(both, "_x", "_t").withColumnsRenamed({"below": "_below", "above": "_above"})
    gap = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    take_above = F.col("_below").isNull() | (F.col("_above").isNotNull() & (gap(F.col("_above"), F.col("_x")) <= gap(F.col("_x"), F.col("_below"))))
    found = put.select(F.col("_x").alias("_k"), F.when(take_above, F.col("_above")).otherwise(F.col("_below")).alias(time))
    if tolerance_s is not None:
        found = found.withColumn(time, F.when(F.abs(gap(F.col(time), F.col("_k"))) <= int(tolerance_s * 1e6), F.col(time)))
    return points.join(F.broadcast(found) if few else found, F.col(key) == F.col("_k"), "left").drop("_k")


def sample_nearest(points: DataFrame, grid: DataFrame, lat: Axis, lon: Axis, out: str, on: tuple[str, ...] = ()) -> DataFrame:
    """OP-33: the value of the nearest cell as ``out``: index arithmetic, then an equi-join."""
    cells = grid.select("lat_idx", "lon_idx", *on, F.col("value").alias(out))
    # never NULL, as Spark would put a filter on what isn't below all that leads to it; no cell has the index -1
    cell = lambda x, axis: F.coalesce(nearest_index(F.col(x), axis), F.lit(-1))
    at = points.withColumns({"lat_idx": cell("Lat", lat), "lon_idx": cell("Lon", lon)})
    return at.join(cells, ["lat_idx", "lon_idx", *on], "left").drop("lat_idx", "lon_idx")


def in_tiles(grid: DataFrame, by: tuple[str, ...], value: str, make: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """``grid`` with double columns that ``make`` gives from whole tiles, in one exchange.

    A tile has ``TILE`` x ``TILE`` cells and a halo of one cell around it, which cells near an edge are copied to. ``make`` gets the values (NaN is missing)
    and whether there is a cell, both with the halo, and gives an array of the tile for each of ``names``; NaN becomes NULL. Rasters are told apart by
    ``by``. Cells that occur twice or without a place have no defined result.
    """
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + k) / TILE) for k in (0, -1, 1)]))
    put = grid.where(F.col("lat_idx").isNotNull() & F.col("lon_idx").isNotNull()).withColumn("_ty", F.explode(near("lat_idx"))).withColumn("_tx", F.explode(near("lon_idx")))
    schema = T.StructType([*grid.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    columns = grid.columns

    def run(t: pa.Table) -> pa.Table:
        i, j = (t.column(c).to_numpy() - t.column(o)[0].as_py() * TILE for c, o in (("lat_idx", "_ty"), ("lon_idx", "_tx")))
        values, there = np.full((TILE + 2, TILE + 2), np.nan), np.zeros((TILE + 2, TILE + 2), bool)
        values[i + 1, j + 1] = t.column(value).to_numpy().astype(float)
        there[i + 1, j + 1] = True
        made = make(values, there)
        own = (i >= 0) & (i < TILE) & (j >= 0) & (j < TILE)
        out = t.select(columns).filter(pa.array(own))
        for n in names:
            x = made[n][i[own], j[own]]
            out = out.append_column(n, pa.array(x, mask=np.isnan(x)))
        return out

    return put.groupBy(*by, "_ty", "_tx").applyInArrow(run, schema)


def _corners(values: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    return {"_01": values[1:-1, 2:], "_10": values[2:, 1:-1], "_11": values[2:, 2:]}


def sample_bilinear(points: DataFrame, grid: DataFrame, lat: Axis, lon: Axis, out: str, key: str = "id", on: tuple[str, ...] = ()) -> DataFrame:
    """OP-34: bilinear interpolation; NULL outside the axes or where one of the four corners is missing.

    Cells carry their right, upper and upper right neighbours, so that a point meets one cell, in one equi-join. An axis of one cell can't be
    interpolated on: then the nearest cell is taken.
    """
    if lat.n < 2 or lon.n < 2:
        return sample_nearest(points, grid, lat, lon, out, on)
    cells = in_tiles(grid.select("lat_idx", "lon_idx", *on, F.col("value").cast("double").alias("_00")), on, "_00", _corners, ("_01", "_10", "_11"))
    y, x = (F.col("Lat") - lat.start) / lat.step, (F.col("Lon") - lon.start) / lon.step
    inside = F.coalesce((y >= 0) & (y <= lat.n - 1) & (x >= 0) & (x <= lon.n - 1), F.lit(False))
    place = lambda v, axis: F.when(inside, F.least(F.floor(v), F.lit(axis.n - 2))).otherwise(-1).cast("int")  # noqa: E731  no cell has the index -1
    put = points.withColumns({"lat_idx": place(y, lat), "lon_idx": place(x, lon), "_y": y - place(y, lat), "_x": x - place(x, lon)})
    met = put.join(cells, ["lat_idx", "lon_idx", *on], "left")
    row = lambda a, b: F.col(a) * (1 - F.col("_x")) + F.col(b) * F.col("_x")  # noqa: E731  NULL where a corner is
    value = row("_00", "_01") * (1 - F.col("_y")) + row("_10", "_11") * F.col("_y")
    return met.select(*points.columns, value.alias(out))


def bounding_box(points: DataFrame, buffer: float, by: tuple[str, ...] = ()) -> DataFrame:
    """OP-37, 50: the box around the points of each group, widened."""
    return points.groupBy(*by).agg(
        (F.min("Lat") - buffer).alias("lat_min"), (F.max("Lat") + buffer).alias("lat_max"), (F.min("Lon") - buffer).alias("lon_min"),
        (F.max("Lon") + buffer).alias("lon_max")
    )


def within_boxes(grid: DataFrame, boxes: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """OP-37: each cell once for each box that holds it, with the columns of both; boxes have lat_min, lat_max, lon_min, lon_max.

    An equi-join by tiles: a box is put in the level whose tiles are as wide as its longer side, so that it meets at most four, and a cell meets one tile
    of each level that some box has (at most ``LEVELS``). ``on`` names columns that must be equal as well, such as the time, so that each slice
    meets its own boxes alone. A box without an edge, or whose edges are swapped, holds nothing.
    """
    edges = ("lat_min", "lat_max", "lon_min", "lon_max")
    side = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"))
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.greatest(side, F.lit(FINEST_DEG)) / FINEST_DEG)))).cast("int")
    valid = boxes.where(F.col("lat_min").isNotNull() & F.col("lon_min").isNotNull() & (F.col("lat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("lon_max")))
    width = lambda l: F.lit(FINEST_DEG) * F.pow(F.lit(2.0), l)
    tile = lambda x, l: F.floor(F.col(x) / width(l))
    put = valid.withColumn("_level", level).withColumn("_ty", F.explode(F.sequence(tile("lat_min", F.col("_level")), tile("lat_max", F.col("_level"))))).withColumn(
        "_tx", F.explode(F.sequence(tile("lon_min", F.col("_level")), tile("lon_max", F.col("_level"))))
    )
    used = [r[0] for r in valid.select(level.alias("l")).distinct().collect()]  # at most LEVELS
    tiles = F.array(*[F.struct(F.lit(l).alias("_level"), tile("lat", F.lit(l)).alias("_ty"), tile("lon", F.lit(l)).alias("_tx")) for l in used]) if used else F.array()
    kind = "array<struct<_level:int,_ty:bigint,_tx:bigint>>"
    cells = grid.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("*", F.inline(tiles.cast(kind)))
    met = cells.join(put, ["_level", "_ty", "_tx", *on])
    return met.where(F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))).drop("_level", "_ty", "_tx", *edges)


def within_box(grid: DataFrame, box: DataFrame, key: str = "cell_id") -> DataFrame:
    """OP-37: the cells in the box, or in one of several, each once. ``key`` tells cells apart."""
    inside = within_boxes(grid.select(key, "lat", "lon"), box.select("lat_min", "lat_max", "lon_min", "lon_max")).select(key).distinct()
    return grid.join(inside, key, "left_semi")


def needed_times(grid: DataFrame, keys: DataFrame, on: str = "time") -> DataFrame:
    """OP-38: only the slices that some point asks for."""
    return grid.join(keys.select(on).distinct(), on, "left_semi")


def mesh(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """OP-44: all cells of two axes. The result is the grid itself, so that the product is its size."""
    return lats.crossJoin(lons)


def _differences(values: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for name, axis in (("_dy", 0), ("_dx", 1)):
        inner = lambda x, k: np.roll(x, -k, axis)[1:-1, 1:-1]
        v, before, after = inner(values, 0), inner(values, -1), inner(values, 1)
        has_before, has_after = inner(there, -1), inner(there, 1)
        one = np.where(has_after, after - v, np.where(has_before, v - before, np.nan))
        out[name] = np.where(has_before & has_after, (after - before) / 2, one)
    return out


def gradient(grid: DataFrame, step_lat: float, step_lon: float, by: tuple[str, ...] = (), mean_lat: str = "slab", value: str = "value") -> DataFrame:
    """OP-67, 91: the size of the gradient per km as ``gradient``: central differences, one-sided at the edges.

    Missing cells must be rows with NULL; what they touch is NULL. An axis of one cell gives NULL. The width of a cell
    follows the mean latitude of the ``by`` group ("slab") or its own ("cell"). Differences are taken in whole tiles, in one exchange.
    """
    d = in_tiles(grid, by, value, _differences, ("_dy", "_dx"))
    if mean_lat == "slab":
        means = grid.groupBy(*by).agg(F.avg("lat").alias("_lat"))
        d = d.join(means, list(by)) if by else d.crossJoin(F.broadcast(means))  # one row
    else:
        d = d.withColumn("_lat", F.col("lat"))
    north = F.col("_dy") / (KM_PER_DEGREE * step_lat)
    east = F.col("_dx") / (F.lit(KM_PER_DEGREE * step_lon) * F.cos(F.radians("_lat")))
    return d.withColumn("gradient", F.sqrt(north * north + east * east)).drop("_dy", "_dx", "_lat")


@dataclass(frozen=True)
class Layer:
    """A raster among several of the same axes: the column that it gives, its cells, and how they are taken.

    ``how`` is "nearest", "bilinear" or "gradient" (per km, at the nearest cell, with the mean latitude of the raster's cells). ``fallback`` gives the nearest
    cell where bilinear interpolation has none: outside the axes or beside a missing corner.
    """

    out: str
    grid: DataFrame
    how: str = "nearest"
    fallback: bool = False


#: Cells around a tile that gradients at its upper corners reach.
_HALO = 2
#: Fixed order: the cell, its right, upper and upper right neighbours.
_CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _names(k: int, layer: Layer) -> list[str]:
    parts = ("_dy", "_dx") if layer.how == "gradient" else ("",)
    return [f"_{k}{part}_{a}{b}" for part in parts for a, b in _CORNERS]


def layered(layers: list[Layer], lat: Axis, lon: Axis, on: tuple[str, ...] = ()) -> DataFrame:
    """The cells of all layers in one row for each place, with what their right and upper neighbours hold: one exchange for all rasters.

    A row stands wherever one of the four is a cell. Cells outside the axes have no place.
    """
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + k) / TILE) for k in (0, -_HALO, _HALO)]))
    here = F.col("lat_idx").between(0, lat.n - 1) & F.col("lon_idx").between(0, lon.n - 1)
    cells = None
    for k, layer in enumerate(layers):
        one = layer.grid.where(here).select(
            F.col("lat_idx").cast("int").alias("lat_idx"), F.col("lon_idx").cast("int").alias("lon_idx"), *on, F.lit(k).alias("_layer"), F.col("value").cast("double").alias("value")
        )
        cells = one if cells is None else cells.unionByName(one)
    names = [n for k, layer in enumerate(layers) for n in _names(k, layer)]
    keys = [cells.schema[c] for c in ("lat_idx", "lon_idx", *on)]
    schema = T.StructType([*keys, *[T.StructField(n, T.DoubleType()) for n in names]])
    hows = [layer.how for layer in layers]

    def run(t: pa.Table) -> pa.Table:
        first = [t.column(c)[0].as_py() * TILE for c in ("_ty", "_tx")]
        i, j = (t.column(c).to_numpy() - f + _HALO for c, f in zip(("lat_idx", "lon_idx"), first, strict=True))
        which, given = t.column("_layer").to_numpy(), t.column("value").to_numpy().astype(float)
        size = TILE + 2 * _HALO
        anywhere, columns = np.zeros((size, size), bool), []
        cut = lambda z, a, b: z[_HALO + a : _HALO + a + TILE, _HALO + b : _HALO + b + TILE]
        for k, how in enumerate(hows):
            mine = which == k
            values, there = np.full((size, size), np.nan), np.zeros((size, size), bool)
            values[i[mine], j[mine]] = given[mine]
            there[i[mine], j[mine]] = True
            anywhere |= there
            if how == "gradient":
                d, inner = _differences(values, there), np.full((size, size), np.nan)
                for part in ("_dy", "_dx"):
                    inner[1:-1, 1:-1] = np.where(there[1:-1, 1:-1], d[part], np.nan)
                    columns += [cut(inner, a, b).copy() for a, b in _CORNERS]
            else:
                columns += [cut(values, a, b) for a, b in _CORNERS]
        y, x = np.nonzero(np.logical_or.reduce([cut(anywhere, a, b) for a, b in _CORNERS]))
        inside = (y + first[0] >= 0) & (x + first[1] >= 0)
        y, x = y[inside], x[inside]
        places = [pa.array((y + first[0]).astype(np.int32)), pa.array((x + first[1]).astype(np.int32))]
        same = [t.column(o).take(pa.array(np.zeros(len(y), np.int64))) for o in on]
        values = [c[y, x] for c in columns]
        return pa.table([*places, *same, *[pa.array(v, mask=np.isnan(v)) for v in values]], names=schema.names)

    dealt = cells.withColumn("_ty", F.explode(near("lat_idx"))).withColumn("_tx", F.explode(near("lon_idx")))
    return dealt.groupBy(*on, "_ty", "_tx").applyInArrow(run, schema)


def sample_layers(points: DataFrame, layers: list[Layer], lat: Axis, lon: Axis, on: tuple[str, ...] = ()) -> DataFrame:
    """OP-33, 34, 39, 67: a column for each layer, for all rasters of the same axes in one equi-join.

    A point is placed once, at the lower left of the four cells around it (of the outermost four where it lies beyond an end), whose row holds what all layers have
    there. The nearest cell is one of the four, ties go to the larger coordinate. ``on`` names columns that points and cells share, such as the time.
    A point without a place or without a row has NULL; bilinear interpolation on an axis of one cell gives the nearest cell.
    """
    y, x = (F.col("Lat") - lat.start) / lat.step, (F.col("Lon") - lon.start) / lon.step
    known = F.col("Lat").isNotNull() & F.col("Lon").isNotNull()
    low = lambda v, axis: F.when(known, F.greatest(F.lit(0), F.least(F.lit(max(0, axis.n - 2)), F.floor(v)))).otherwise(-1).cast("int")  # noqa: E731  no cell has the index -1
    met = points.withColumns({"lat_idx": low(y, lat), "lon_idx": low(x, lon)}).join(layered(layers, lat, lon, on), ["lat_idx", "lon_idx", *on], "left")
    # made after the join, as its exchange would carry them
    met = met.withColumns({
        "_y": y - F.col("lat_idx"), "_x": x - F.col("lon_idx"), "_up": nearest_index(F.col("Lat"), lat) > F.col("lat_idx"), "_right": nearest_index(F.col("Lon"), lon) > F.col("lon_idx")
    })
    pick = lambda c: F.when(F.col("_up"), F.when(F.col("_right"), c[3]).otherwise(c[2])).otherwise(F.when(F.col("_right"), c[1]).otherwise(c[0]))
    inside = F.coalesce(y.between(0, lat.n - 1) & x.between(0, lon.n - 1), F.lit(False))
    row = lambda a, b: a * (1 - F.col("_x")) + b * F.col("_x")  # noqa: E731  NULL where a corner is
    out = {}
    for k, layer in enumerate(layers):
        c = [F.col(n) for n in _names(k, layer)]
        if layer.how == "gradient":
            means = layer.grid.groupBy(*on).agg(F.avg("lat").alias(f"_lat{k}"))
            met = met.join(means, list(on), "left") if on else met.crossJoin(F.broadcast(means))  # one row
            north, east = pick(c[:4]) / (KM_PER_DEGREE * lat.step), pick(c[4:]) / (F.lit(KM_PER_DEGREE * lon.step) * F.cos(F.radians(f"_lat{k}")))
            out[layer.out] = F.sqrt(north * north + east * east)
        elif layer.how == "bilinear" and lat.n > 1 and lon.n > 1:
            value = F.when(inside, row(c[0], c[1]) * (1 - F.col("_y")) + row(c[2], c[3]) * F.col("_y"))
            out[layer.out] = F.coalesce(value, pick(c)) if layer.fallback else value
        else:
            out[layer.out] = pick(c)
    kept = [c for c in points.columns if c not in out]
    return met.select(*kept, *[v.alias(n) for n, v in out.items()])


def is_ocean(points: DataFrame, altitude: DataFrame, lat: Axis, lon: Axis) -> DataFrame:
    """OP-30: ``points`` over cells below sea level; a cell without a value is not ocean."""
    return sample_nearest(points, altitude, lat, lon, "_altitude").where(F.col("_altitude") < 0).drop("_altitude")
