"""The nearest cell of a set, exactly, by a pyramid of tiles with bounds (OP-35, 36)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import KM_PER_DEGREE, haversine_km
from ..sources.tables import discard_since, named, scratch, stage

#: Cells that a tile of the finest level would hold if they were spread evenly.
CELLS_A_TILE = 2
#: Tiles on an axis of the level whose boxes come to the driver, at most: 16,384 boxes of points and of cells, whatever the tables' sizes.
COARSE = 128
#: The most cells of a tile's pairs that are put into one row, for each set of cells; the points of tiles with more meet several rows.
MOST_IN_ROW = 4096
_BOX = ("y0", "y1", "x0", "x1")


def _tile(y: Column, x: Column, width: float, origin: tuple[float, float]) -> Column:
    """A tile's number from coordinates; its parent's has both halves shifted by two bits."""
    at = lambda v, o: F.floor((v - o) / width).cast("long")
    return F.shiftleft(at(y, origin[0]), 31).bitwiseOR(at(x, origin[1]))


def _parent(tile: Column) -> Column:
    return F.shiftleft(F.shiftright(tile, 33), 31).bitwiseOR(F.shiftright(tile.bitwiseAND((1 << 31) - 1), 2))


def _pyramid(df: DataFrame, levels: int, side: str) -> list[DataFrame]:
    """Occupied tiles of each level, the finest first: number, parent's number, and the box of what they hold."""
    box = lambda y, x: [F.min(y[0]).alias(f"{side}y0"), F.max(y[1]).alias(f"{side}y1"), F.min(x[0]).alias(f"{side}x0"), F.max(x[1]).alias(f"{side}x1")]
    out = [df.groupBy(side).agg(*box(("_y", "_y"), ("_x", "_x")))]
    if levels > 1:  # each level is made from it where it is used
        out = [stage(out[0], scratch(df.sparkSession, "tiles"), tidy=True)]
    for _ in range(levels - 1):
        up = out[-1].withColumn(side, _parent(F.col(side))).groupBy(side).agg(*box((f"{side}y0", f"{side}y1"), (f"{side}x0", f"{side}x1")))
        out.append(up)
    return [t.withColumn(f"{side}_up", _parent(F.col(side))) for t in out]


def _coarse_pairs(tiles: DataFrame, cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of coarse tiles that stay, found from their boxes through tiles four times as wide each."""
    levels = []
    for df, side in ((tiles, "p"), (cells, "c")):
        t = df.select(side, *[f"{side}{n}" for n in _BOX]).toPandas().to_numpy()
        number, box = [t[:, 0].astype(np.int64)], [t[:, 1:].astype(float)]
        while True:
            up, at = np.unique((number[-1] >> 33 << 31) | ((number[-1] & ((1 << 31) - 1)) >> 2), return_inverse=True)
            wide = np.tile([np.inf, -np.inf, np.inf, -np.inf], (len(up), 1))
            for k, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum)):
                f.at(wide[:, k], at, box[-1][:, k])
            order = np.argsort(at, kind="stable")
            levels.append((side, number[-1][order], box[-1][order], np.searchsorted(at[order], np.arange(len(up) + 1))))
            number, box = [up], [wide]
            if len(up) == 1 and up[0] == 0:
                break
    of = {s: [x[1:] for x in levels if x[0] == s] for s in "pc"}
    deepest = max(map(len, of.values()))
    for s in "pc":  # a side that comes to one tile sooner waits at it
        of[s] += [(np.zeros(1, np.int64), of[s][-1][1][:1] * 0 + [[b[:, 0].min(), b[:, 1].max(), b[:, 2].min(), b[:, 3].max()] for b in [of[s][0][1]]], np.array([0, 1]))] * (deepest - len(of[s]))
    p, c = np.zeros(1, np.int64), np.zeros(1, np.int64)  # places of the pairs' tiles in the level above
    for k in range(deepest - 1, -1, -1):
        (pn, pb, pcut), (cn, cb, ccut) = of["p"][k], of["c"][k]
        np_, nc = pcut[p + 1] - pcut[p], ccut[c + 1] - ccut[c]
        pair = np.repeat(np.arange(len(p)), np_ * nc)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(np_ * nc) - np_ * nc, np_ * nc)
        p, c = pcut[p[pair]] + within // nc[pair], ccut[c[pair]] + within % nc[pair]
        a, b = pb[p], cb[c]
        near = [np.maximum(np.maximum(b[:, i] - a[:, i + 1], a[:, i] - b[:, i + 1]), 0) for i in (0, 2)]
        far = [np.maximum(np.abs(a[:, i + 1] - b[:, i]), np.abs(b[:, i + 1] - a[:, i])) for i in (0, 2)]
        least = np.full(len(pn), np.inf)
        np.minimum.at(least, p, far[0] ** 2 + far[1] ** 2)
        stays = near[0] ** 2 + near[1] ** 2 <= least[p] * (1 + 1e-9) + 1e-9
        p, c = p[stays], c[stays]
        # tiles are in the order of their parents; the level below counts parents in the order of their numbers
        p, c = np.argsort(np.argsort(pn))[p], np.argsort(np.argsort(cn))[c]
    return np.sort(of["p"][0][0])[p], np.sort(of["c"][0][0])[c]


def _gap2(p: tuple[Column, Column, Column, Column], c: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Squares of the least and the largest distance between a place in one box and one in the other; boxes are (y0, y1, x0, x1)."""
    zero = F.lit(0.0)
    near = [F.greatest(c[i] - p[i + 1], p[i] - c[i + 1], zero) for i in (0, 2)]
    far = [F.greatest(F.abs(p[i + 1] - c[i]), F.abs(c[i + 1] - p[i])) for i in (0, 2)]
    return near[0] * near[0] + near[1] * near[1], far[0] * far[0] + far[1] * far[1]


def _kept(lower: Column, upper: Column) -> Column:
    """Whether what is at least ``lower`` away may win against what is at most ``upper`` away; ties stay, also where rounding differs."""
    return lower <= upper * (1 + 1e-9) + 1e-9


def nearest_cell(points: DataFrame, cells: DataFrame, out: str, tile_km: float | None = None, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with ``out``, the haversine distance in km to the cell nearest in the plane; ``nearest_cells`` for one set of cells. ``keep`` names columns of the winner to keep."""
    # dealt out by key, as few large files or a tile of many points would leave the work to few tasks
    spark = points.sparkSession
    held = stage(points.repartition(spark.sparkContext.defaultParallelism, key), scratch(spark, "points"), tidy=True)
    return nearest_cells(held, {out: cells}, tile_km, key, keep)


def nearest_cells(points: DataFrame, sets: dict[str, DataFrame], tile_km: float | None = None, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``points``, a table that was written, with a column for each of ``sets``: the haversine distance in km to the set's cell nearest in the plane.

    Plane coordinates scale longitude by the cosine of the points' mean latitude. Points and cells are gathered in tiles of a pyramid, each with the
    box of what it holds. From the coarsest level on, pairs of tiles go on to their children, but for pairs whose
    least distance is more than the largest distance to some other tile of cells: far points share the work of their tile, and the pairs of
    a tile are those around its nearest cells, however far these are. In the end the points of a tile meet the cells of its pairs, of all sets in one row, so that points are moved once, with all their columns.
    Sets have cell_id, lat, lon; equal distances go to the least cell_id. Without cells, or a point's coordinates,
    the distance is NULL. ``keep`` names columns of the first set's winner to keep. Tiles with more than ``MOST_IN_ROW`` cells in their pairs are met in several rows,
    whose least is taken by ``key``; points of one key share its row's result there, so that it must tell points apart.
    """
    spark, mark = points.sparkSession, named()
    ends = lambda lat, lon: [f(c).alias(n) for f, c, n in ((F.min, lat, "y0"), (F.max, lat, "y1"), (F.min, lon, "x0"), (F.max, lon, "x1"))]
    lat, lon = F.col("Lat").cast("double"), F.col("Lon").cast("double")
    placed = points.where(F.col("Lat").isNotNull() & F.col("Lon").isNotNull())
    a = placed.agg(F.avg(lat).alias("mean"), *ends(lat, lon)).first()
    right, area, missing, bounds = {}, {}, {}, []
    for out, cells in sets.items():
        met = Observation()
        own = cells.select("cell_id", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"), *keep).where("_lat IS NOT NULL AND _lon IS NOT NULL")
        own = stage(own.observe(met, F.count("*").alias("n"), *ends("_lat", "_lon")), scratch(spark, "cells"), tidy=True)
        b = met.get
        if a["mean"] is None or not b["n"]:
            missing |= {out: F.lit(None).cast("double"), **{k: F.lit(None).cast(cells.schema[k].dataType) for k in keep}}
            continue
        right[out], area[out] = own, (b["n"], b["y1"] - b["y0"], b["x1"] - b["x0"])
        bounds.append(b)
    if not right:
        return points.withColumns(missing)
    # the width of a degree is positive, also where a mean latitude beyond a pole has a negative cosine
    ky, kx = KM_PER_DEGREE, KM_PER_DEGREE * abs(math.cos(math.radians(a["mean"])))
    end = lambda f, n: f(a[n], *[b[n] for b in bounds])
    origin = end(min, "y0") * ky, end(min, "x0") * kx
    span = max(end(max, "y1") * ky - origin[0], end(max, "x1") * kx - origin[1], 1e-6)
    fine = min(math.sqrt(max(h * ky, 1e-3) * max(w * kx, 1e-3) * CELLS_A_TILE / n) for n, h, w in area.values())  # the tiles of the densest set
    width = max(tile_km or fine, span / 2**28)
    levels = 1
    while span / (width * 4 ** (levels - 1)) >= COARSE:
        levels += 1

    plane = lambda df, y, x, side: df.withColumns({"_y": y * ky, "_x": x * kx}).withColumn(side, _tile(F.col("_y"), F.col("_x"), width, origin))
    of_points = _pyramid(plane(placed.select("Lat", "Lon"), lat, lon, "p"), levels, "p")
    met, kept = {}, []
    for out, own in right.items():
        tiled = plane(own, F.col("_lat"), F.col("_lon"), "c")
        pairs = _pairs(of_points, _pyramid(tiled, levels, "c"), levels)
        kept.append(scratch(spark, "met"))
        met[out] = stage(pairs.join(tiled.select("c", "cell_id", "_lat", "_lon", *keep), "c"), kept[-1], tidy=True)
    put = points.withColumn("p", F.when(lat.isNotNull() & lon.isNotNull(), _tile(lat * ky, lon * kx, width, origin)))
    cell = F.struct("cell_id", "_lat", "_lon", *keep)
    names = list(met)
    every = None
    for k, out in enumerate(names):
        one = met[out].select("p", F.lit(k).alias("_set"), cell.alias("_cell"))
        every = one if every is None else every.unionByName(one)
    sizes = every.groupBy("p", "_set").agg(F.count("*").alias("_n"))
    crowded = None
    if sizes.agg(F.max("_n")).first()[0] > MOST_IN_ROW:
        crowded = F.broadcast(sizes.where(F.col("_n") > MOST_IN_ROW).select("p").distinct())
        every = every.join(crowded, "p", "left_anti")
    lists = every.groupBy("p").agg(*[F.collect_list(F.when(F.col("_set") == k, F.col("_cell"))).alias(f"_cells{k}") for k in range(len(names))])
    # written, so that the points meet them in a plain join, whose large tiles Spark can split
    kept = [*(kept if crowded is not None else []), scratch(spark, "lists")]
    lists = stage(lists, kept[-1], tidy=True).hint("merge")
    discard_since(spark, mark, *kept)
    py, px = lat * ky, lon * kx
    d = lambda c: (py - c["_lat"] * ky) * (py - c["_lat"] * ky) + (px - c["_lon"] * kx) * (px - c["_lon"] * kx)
    least = lambda cells: F.array_min(F.transform(cells, lambda c: F.struct(d(c).alias("d"), *[c[n].alias(n) for n in ("cell_id", "_lat", "_lon", *keep)])))
    here = put if crowded is None else put.join(crowded, "p", "left_anti")
    # the least of each list is taken where the lists are met, in a step of its own, so that they go no further
    won = here.join(lists, "p", "left").select(*points.columns, *[least(f"_cells{k}").alias(f"_b{k}") for k in range(len(names))])
    if crowded is not None:
        far = put.join(crowded, "p", "left_semi")
        for k, out in enumerate(names):
            of_tile = met[out].join(crowded, "p", "left_semi").groupBy("p", _parent(_parent(F.col("c"))).alias("_of"))
            rows = far.select(key, "p", "Lat", "Lon").join(of_tile.agg(F.collect_list(cell).alias("_cells")).drop("_of"), "p")
            far = far.join(rows.select(key, least("_cells").alias("_b")).groupBy(key).agg(F.min("_b").alias(f"_b{k}")), key, "left")
        won = won.unionByName(far.drop("p"))
    found = {out: haversine_km(F.col("Lat"), F.col("Lon"), F.col(f"_b{k}._lat"), F.col(f"_b{k}._lon")) for k, out in enumerate(names)}
    return won.withColumns({**{n: F.col(f"_b0.{n}") for n in keep}, **found, **missing}).drop(*[f"_b{k}" for k in range(len(names))])


def _pairs(of_points: list[DataFrame], of_cells: list[DataFrame], levels: int) -> DataFrame:
    """The pairs of finest tiles that stay, from the coarsest level's on.

    Tiles of cells are put in first, then those of points, whose parents' exchange is also that of the bounds: what is moved is a sixteenth of the pairs that are looked at.
    """
    first = _coarse_pairs(of_points[-1], of_cells[-1])
    pairs = of_points[0].sparkSession.createDataFrame(pa.table({"p": first[0], "c": first[1]})).withColumn("_bound", F.lit(math.inf))
    for k in range(levels - 2, -1, -1):
        of_c = pairs.select(F.col("p").alias("p_up"), F.col("c").alias("c_up"), "_bound").join(of_cells[k], "c_up").drop("c_up")
        met = of_c.join(of_points[k].hint("merge"), "p_up")
        lower, upper = _gap2(*(tuple(F.col(f"{s}{n}") for n in _BOX) for s in "pc"))
        # a parent's bound holds for its children
        near = met.select("p_up", "p", "c", "_bound", lower.alias("_lower"), upper.alias("_upper")).where(_kept(F.col("_lower"), F.col("_bound")))
        bounded = near.withColumn("_bound", F.min("_upper").over(W.partitionBy("p_up", "p"))).where(_kept(F.col("_lower"), F.col("_bound")))
        pairs = bounded.select("p", "c", "_bound")
    return pairs.select("p", "c")
