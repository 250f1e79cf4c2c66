"""Rasters read in bands, by time and box, from NetCDF files and other openers; boxes by key."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import raster
from tidewright.sources import cubes, netcdf

UTC = datetime.timezone.utc
LAT, LON = 30 + 0.5 * np.arange(21), -75 + 0.5 * np.arange(11)


def made(day: int) -> np.ndarray:
    v = np.add.outer(np.arange(21.0) * 7, np.arange(11.0) * 3) % 11 + day
    v[3, 3] = np.nan
    return v


def plane(key, box):
    """An opener that gives what lies in the box."""
    at = datetime.datetime(2024, 1, 1, 9) + datetime.timedelta(days=int(key))
    rows, columns = ((x >= box.get(n, (-math.inf, 0))[0]) & (x <= box.get(n, (0, math.inf))[1]) for n, x in (("lat", LAT), ("lon", LON)))
    return [cubes.Plane(at, 0, np.flatnonzero(rows), np.flatnonzero(columns), LAT[rows], LON[columns], made(int(key))[rows][:, columns])]


def broken(key, box):
    """Key 2 can't be had; the others have 400 cells."""
    if key == "2":
        raise OSError("no such slab")
    at = datetime.datetime(2024, 1, int(key))
    axis = np.arange(20)
    whole = cubes.Plane(at, 0, axis, axis, axis * 0.05, axis * 0.05, np.zeros((20, 20)))
    inside = (whole.lat >= box["lat"][0]) & (whole.lat <= box["lat"][1])
    return [cubes.Plane(at, 0, axis[inside], axis, whole.lat[inside], whole.lon, whole.values[inside])]


def told(key, box):
    """One cell whose value says with which box the opener was called; its latitude is the band's north end."""
    return [cubes.Plane(None, None, np.zeros(1, int), np.zeros(1, int), np.array([box["lat"][0]]), np.array([box["lon"][1]]), np.array([[float(len(box))]]))]


def as_rows(df):
    return sorted((r.time, r.lat_idx, r.lon_idx, r.lat, r.lon, r.value) for r in df.collect())


def test_ranges_reach_the_opener(spark):
    cube = cubes.read_cube(spark, "tests.test_rasters:told", ["1"])
    r = cubes.slab(cube, (35.0, 36.0), (-75.0, -74.0)).first()
    assert (r.lat, r.lon, r.value) == (35.0, -74.0, 2.0)


@pytest.mark.parametrize("band", ["1", "2.5", "15", "180"])
def test_bands_give_each_cell_once(spark, band):
    cube = cubes.read_cube(spark, "tests.test_rasters:plane", ["0", "1"], band=band)
    rows = as_rows(cube)
    assert len(rows) == len({r[:3] for r in rows}) == 2 * 21 * 11
    part = as_rows(cubes.slab(cube, (31.2, 35.0), (-74.0, -73.0)))
    assert part == [r for r in rows if 31.2 <= r[3] <= 35.0 and -74.0 <= r[4] <= -73.0] and len(part) == 2 * 8 * 3
    assert cube.rdd.getNumPartitions() == 2 * math.ceil(180 / float(band))
    assert cubes.slab(cube, (31.2, 32.0), (-74.0, -73.0)).rdd.getNumPartitions() <= 2 * (1 + math.ceil(0.8 / float(band)))


def test_times_rule_keys_out(spark):
    """Only the key of the time asked for is opened; the others have no task."""
    start = datetime.datetime(2024, 1, 1, 9, tzinfo=UTC)
    keys = [cubes.Key(str(k), start + datetime.timedelta(days=k)) for k in range(8)]
    cube = cubes.read_cube(spark, "tests.test_rasters:plane", keys, band="180")
    asked = lambda when: cube.where(when)
    at = F.lit("2024-01-04 09:00:00").cast("timestamp")
    one = asked(F.col("time") == at)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 231
    assert asked(F.col("time") > at).rdd.getNumPartitions() in (4, 5) and asked(F.col("time") > at).count() == 4 * 231
    two = asked(F.col("time").isin(start, start + datetime.timedelta(days=5)))
    assert two.rdd.getNumPartitions() == 2 and two.count() == 462
    assert asked(F.col("time") < F.lit("2000-01-01").cast("timestamp")).count() == 0


def test_each_time_reads_its_own_box(spark):
    start = datetime.datetime(2024, 1, 1, 9, tzinfo=UTC)
    keys = {start + datetime.timedelta(days=k): str(k) for k in range(4)}
    points = spark.createDataFrame(
        [(start, 31.0, -74.0), (start, 32.0, -73.0), (start + datetime.timedelta(days=2), 39.0, -71.0), (None, 30.0, -75.0)], "time timestamp, Lat double, Lon double"
    )
    got = as_rows(cubes.read_around(spark, "tests.test_rasters:plane", keys, points, 0.25))
    assert {(r[0].day, r[3], r[4]) for r in got} == {(1, y, x) for y in (31.0, 31.5, 32.0) for x in (-74.0, -73.5, -73.0)} | {(3, 39.0, -71.0)}
    assert cubes.read_around(spark, "tests.test_rasters:plane", keys, points.limit(0)).count() == 0


@pytest.mark.parametrize("record", [False, True])
@pytest.mark.parametrize("order", ["tyx", "txy", "yx", "tzyx"])
def test_netcdf(spark, tmp_path, record, order):
    """Files of all orders of axes, with and without an unlimited one; a descending axis, fill values, bands."""
    lat = LAT[::-1] if order == "tyx" else LAT
    value = np.stack([made(0), made(1)])[:, ::-1] if order == "tyx" else np.stack([made(0), made(1)])
    axes = {"time": np.array([0.0, 1.5]), "latitude": lat, "longitude": LON}
    if order == "txy":
        axes, value = {k: axes[k] for k in ("time", "longitude", "latitude")}, value.transpose(0, 2, 1)
    elif order == "yx":
        axes, value = {k: axes[k] for k in ("latitude", "longitude")}, value[0]
    elif order == "tzyx":
        axes, value = {"time": axes["time"], "depth": np.array([5.0, 10.0, 20.0]), "latitude": lat, "longitude": LON}, np.stack([value, value + 100, value + 200], 1)
    path = str(tmp_path / "r.nc")
    netcdf.write_classic(path, axes, "sst", value, "days since 2020-01-01 09:00:00", record=record)
    if "time" in axes:
        assert netcdf.times(path) == [datetime.datetime(2020, 1, 1, 9), datetime.datetime(2020, 1, 2, 21)]
    key = f"{path}|sst|{1 if 'time' in axes else ''}|{2 if order == 'tzyx' else ''}"
    got = as_rows(cubes.slab(cubes.read_cube(spark, "tidewright.sources.netcdf:open_bands", [f"file://{key}"], band="2"), (31.0, 34.0), (-74.0, -72.0)))
    day = 1 if "time" in axes else 0
    want = made(day) + (200 if order == "tzyx" else 0)
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(i, j, LAT[i], LON[j]) for i in range(2, 9) for j in range(2, 7)]
    assert all(r[5] is None if np.isnan(want[r[1], r[2]]) else r[5] == want[r[1], r[2]] for r in got)
    assert {r[0] for r in got} == {datetime.datetime(2020, 1, 2, 21) if day else None}


def test_netcdf_refuses_other_files(tmp_path):
    (tmp_path / "x").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(100))
    with pytest.raises(OSError):
        netcdf.open_bands(f"{tmp_path}/x|sst||", {})
    netcdf.write_classic(str(tmp_path / "y"), {"lat": LAT, "lon": LON}, "v", made(0))
    with pytest.raises(OSError):
        netcdf.open_bands(f"{tmp_path}/y|sst||", {})
    whole = (tmp_path / "y").read_bytes()
    (tmp_path / "z").write_bytes(whole[:-20])
    with pytest.raises(OSError):
        netcdf.open_bands(f"{tmp_path}/z|v||", {})


def test_ten_million_cells_in_bands(spark, tmp_path):
    """A task reads its band alone, and the cells leave it in batches of bounded size."""
    n = 3200
    lat, lon = -80 + np.arange(n) * 0.05, -80 + np.arange(n) * 0.05
    path = str(tmp_path / "big.nc")
    netcdf.write_classic(path, {"lat": lat, "lon": lon}, "v", np.add.outer(np.arange(n) % 7, np.arange(n) % 5).astype(float))
    cube = cubes.read_cube(spark, "tidewright.sources.netcdf:open_bands", [f"{path}|v||"], band="10")
    got = cube.agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.count_distinct("lat_idx").alias("rows")).first()
    assert (got.n, got.rows) == (n * n, n) and got.s == n * (sum(i % 7 for i in range(n)) + sum(j % 5 for j in range(n)))
    [one] = netcdf.open_bands(f"{path}|v||", {"lat": (0.0, 10.0)})
    assert one.values.shape == (201, n)
    assert max(b.num_rows for b in cubes.batches_of(one)) <= cubes.BATCH_CELLS


def test_boxes_by_key(spark):
    """Boxes of very different sizes, by key, some of one time: the cells in each, as by comparing all."""
    r = random.Random(4)
    cells = [(k, 30 + r.random() * 20, -80 + r.random() * 20, k % 3) for k in range(600)]
    boxes = []
    for b in range(40):
        y, x, h, w = 28 + r.random() * 22, -82 + r.random() * 22, 10 ** r.uniform(-2, 1.5), 10 ** r.uniform(-2, 1.5)
        boxes.append((b, y, y + h, x, x + w, b % 3))
    boxes += [(100, None, 1.0, 1.0, 1.0, 0), (101, 35.0, 35.0, -70.0, -70.0, 0), (102, 40.0, 30.0, -70.0, -60.0, 1), (103, cells[0][1], cells[0][1], cells[0][2], cells[0][2], 0)]
    grid = spark.createDataFrame(cells, "cell_id long, lat double, lon double, slot long")
    asked = spark.createDataFrame(boxes, "box long, lat_min double, lat_max double, lon_min double, lon_max double, slot long")
    inside = lambda c, b: b[1] is not None and b[1] <= c[1] <= b[2] and b[3] <= c[2] <= b[4]
    got = {(x.box, x.cell_id) for x in raster.within_boxes(grid.drop("slot"), asked.drop("slot")).collect()}
    assert got == {(b[0], c[0]) for b in boxes for c in cells if inside(c, b)}
    same = raster.within_boxes(grid, asked, on=("slot",))
    assert {(x.box, x.cell_id) for x in same.collect()} == {(b[0], c[0]) for b in boxes for c in cells if inside(c, b) and b[5] == c[3]}
    assert raster.within_boxes(grid.drop("slot"), asked.drop("slot").limit(0)).count() == 0
    plan = same._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_one_box_must_be_one(spark):
    grid = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "cell_id long, lat double, lon double")
    box = spark.createDataFrame([(0.0, 2.0, 0.0, 2.0), (4.0, 6.0, 4.0, 6.0)], "lat_min double, lat_max double, lon_min double, lon_max double")
    assert {r.cell_id for r in raster.within_box(grid, box.limit(1)).collect()} == {1}
    assert {r.cell_id for r in raster.within_box(grid, box).collect()} == {1, 2}  # in one of them


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_neighbours_in_tiles(spark, monkeypatch, tile):
    """Gradients and corners don't depend on where tiles lie; rasters by time, a missing cell, an axis of one cell, negative indices."""
    monkeypatch.setattr(raster, "TILE", tile)
    g = np.random.default_rng(1)
    z = g.normal(size=(2, 7, 9)).round(3)
    z[1, 3, 4] = np.nan
    rows = [(t, i - 3, j, 35 + 0.1 * i, -75 + 0.1 * j, None if np.isnan(z[t, i, j]) else float(z[t, i, j])) for t in (0, 1) for i in range(7) for j in range(9)]
    grid = spark.createDataFrame(rows, "t int, lat_idx int, lon_idx int, lat double, lon double, value double")
    got = {(r.t, r.lat_idx + 3, r.lon_idx): r.gradient for r in raster.gradient(grid, 0.1, 0.1, by=("t",)).collect()}
    for t in (0, 1):
        dy, dx = np.gradient(z[t])
        want = np.hypot(dy / (111.32 * 0.1), dx / (111.32 * 0.1 * math.cos(math.radians(35.3))))
        assert all((got[t, i, j] is None) == bool(np.isnan(want[i, j])) and (got[t, i, j] is None or got[t, i, j] == pytest.approx(want[i, j])) for i in range(7) for j in range(9))
    line = raster.gradient(grid.where("lat_idx = 0 AND t = 0"), 0.1, 0.1)
    assert {r.gradient for r in line.collect()} == {None}
    from tidewright.schema import Axis

    at = [(k, k % 2, 35 + g.random() * 0.7, -75.05 + g.random() * 0.95) for k in range(150)] + [(200, 0, 35.6, -74.2), (201, 0, None, -74.5)]
    pts = spark.createDataFrame(at, "id long, t int, Lat double, Lon double")
    up = grid.withColumn("lat_idx", F.col("lat_idx") + 3)
    got = {r.id: r.v for r in raster.sample_bilinear(pts, up, Axis(35.0, 0.1, 7), Axis(-75.0, 0.1, 9), "v", on=("t",)).collect()}
    assert len(got) == 152
    for k, t, lat, lon in at:
        y, x = ((lat or 0) - 35) / 0.1, (lon + 75) / 0.1
        if lat is None or not (0 <= y <= 6 and 0 <= x <= 8):
            assert got[k] is None
            continue
        i, j = min(int(y), 5), min(int(x), 7)
        c = z[t, i : i + 2, j : j + 2]
        want = (c * np.outer([1 - (y - i), y - i], [1 - (x - j), x - j])).sum()
        assert got[k] is None if np.isnan(want) else got[k] == pytest.approx(want)
    one = raster.sample_bilinear(pts, up.where("lat_idx = 2").withColumn("lat_idx", F.lit(0)), Axis(35.2, 0.1, 1), Axis(-75.0, 0.1, 9), "v", on=("t",))  # an axis of one cell: the nearest
    assert {r.id: r.v for r in one.collect()}[200] == z[0, 2, 8]


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_layers_in_one_join(spark, monkeypatch, tile):
    """Several rasters met at once give what each gives alone, wherever tiles lie: points beyond the axes, on edges and without a place, missing cells and rows."""
    from tidewright.schema import Axis

    monkeypatch.setattr(raster, "TILE", tile)
    g = np.random.default_rng(2)
    lat, lon = Axis(35.0, 0.1, 7), Axis(-75.0, 0.1, 9)
    rows = [(t, i, j, 35 + 0.1 * i, -75 + 0.1 * j, None if g.random() < 0.05 else float(g.normal().__round__(3))) for t in (0, 1) for i in range(7) for j in range(9) if (i, j) != (2, 2)]
    a = spark.createDataFrame(rows, "t int, lat_idx int, lon_idx int, lat double, lon double, value double")
    b = a.where("(lat_idx + 2 * lon_idx + t) % 4 != 0").withColumn("value", F.col("value") * 3)  # cells that only one of the two has
    at = [(k, k % 3, 34.8 + g.random() * 1.1, -75.2 + g.random() * 1.2) for k in range(200)] + [(300, 0, 35.6, -74.2), (301, 1, 35.05, -74.85), (302, 0, None, -74.5), (303, 1, 35.2, None), (304, None, 35.2, -74.5)]
    pts = spark.createDataFrame(at, "id long, t int, Lat double, Lon double")
    for on, take in ((("t",), lambda d: d), ((), lambda d: d.where("t = 0"))):
        x, y = take(a), take(b)
        layers = [raster.Layer("n", x), raster.Layer("s", y), raster.Layer("l", x, "bilinear"), raster.Layer("f", x, "bilinear", fallback=True), raster.Layer("g", x, "gradient")]
        got = {r.id: r for r in raster.sample_layers(pts, layers, lat, lon, on).collect()}
        assert len(got) == len(at)
        slope = raster.gradient(x, 0.1, 0.1, by=on).withColumn("value", F.col("gradient"))
        alone = {
            "n": raster.sample_nearest(pts, x, lat, lon, "v", on), "s": raster.sample_nearest(pts, y, lat, lon, "v", on),
            "l": raster.sample_bilinear(pts, x, lat, lon, "v", on=on), "g": raster.sample_nearest(pts, slope, lat, lon, "v", on)
        }
        for name, df in alone.items():
            want = {r.id: r.v for r in df.collect()}
            assert {k: got[k][name] is None for k in got} == {k: want[k] is None for k in got}, name
            assert all(want[k] is None or got[k][name] == pytest.approx(want[k]) for k in got), name
        assert all(r.f == (r.n if r.l is None else r.l) for r in got.values())
        assert any(r.l is None and r.n is not None for r in got.values())
    line = raster.sample_layers(pts, [raster.Layer("v", a.where("t = 0 AND lat_idx = 0"), "bilinear")], Axis(35.0, 0.1, 1), lon)  # an axis of one cell
    want = {r.id: r.v for r in raster.sample_nearest(pts, a.where("t = 0 AND lat_idx = 0"), Axis(35.0, 0.1, 1), lon, "v").collect()}
    assert {r.id: r.v for r in line.collect()} == want
    assert raster.sample_layers(pts, layers, lat, lon).limit(0).count() == 0 == raster.sample_layers(pts.limit(0), layers, lat, lon).count()


def test_rasters_of_the_same_axes_are_one_join(spark):
    from tidewright.plans import habitat
    from tidewright.schema import Axis, GridSpec

    cells = spark.createDataFrame([(0, 0, 35.0, -75.0, 1.0)], "lat_idx int, lon_idx int, lat double, lon double, value double")
    spec = GridSpec("v", Axis(35.0, 0.1, 2), Axis(-75.0, 0.1, 2))
    pts = spark.createDataFrame([(1, 35.0, -75.0)], "id long, Lat double, Lon double")
    out = habitat.sample_all(pts, [(spec, raster.Layer(n, cells, how)) for n, how in (("a", "nearest"), ("b", "bilinear"), ("c", "nearest"), ("d", "nearest"))])
    assert [tuple(r) for r in out.select("id", "a", "b", "c", "d").collect()] == [(1, 1.0, None, 1.0, 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("FlatMapGroupsInArrow") == 1


def test_steps_give_what_the_joint_chain_gives(spark):
    """Variables added to a table one at a time (patches, fronts, relief) equal those sampled at once; a raster of eastern longitudes is met at its own."""
    from tidewright.plans import habitat
    from tidewright.schema import Axis, GridSpec

    g = np.random.default_rng(5)
    lat, lon = Axis(35.0, 0.1, 6), Axis(-75.0, 0.1, 5)
    cells = [(i, j, 35 + 0.1 * i, -75 + 0.1 * j, float(g.normal() * 300 - 100)) for i in range(6) for j in range(5)]
    alt = spark.createDataFrame(cells, "lat_idx int, lon_idx int, lat double, lon double, value double")
    sst = alt.withColumn("time", F.explode(F.expr("array(TIMESTAMP'2001-01-01 09:00:00', TIMESTAMP'2001-03-01 09:00:00')"))).withColumn("value", F.when(F.col("lat_idx") + F.month("time") != 2, F.col("value") / 50 + F.month("time")))
    gaps, salt = alt.withColumn("value", F.when(F.col("lon_idx") % 2 == 0, F.col("value"))), alt.withColumn("value", F.col("value") + 7)
    rows = [(k, 34.95 + g.random() * 0.6, -75.05 + g.random() * 0.5, f"2001-0{1 + k % 4}-17") for k in range(60)]
    pts = spark.createDataFrame(rows, "id long, Lat double, Lon double, day string").withColumn("Date", F.to_timestamp("day"))
    days, still = GridSpec("sst", lat, lon, temporal="day"), GridSpec("v", lat, lon)
    once = habitat.variables(pts, sst, gaps, alt, salt, alt, days, still)
    steps = habitat.sample(pts, sst, days, "SST")
    steps = habitat.patched(habitat.sample(steps, gaps, still, "Chlorophyll"), alt, still, "Chlorophyll")
    steps = habitat.sample(steps, salt, GridSpec("salt", lat, lon, nearest=False), "Salinity")
    steps = habitat.with_relief(habitat.with_front(habitat.sample(steps, alt, still, "Bathymetry"), sst, days), alt, still)
    names = ["id", "SST", "Chlorophyll", "Salinity", "Bathymetry", "SST_Gradient", "Is_Thermal_Front", "Bathy_Slope"]
    got = {r.id: tuple(r) for r in once.select(*names).collect()}
    assert got == {r.id: tuple(r) for r in steps.select(*names).collect()} and len(got) == 60
    assert any(v[1] is None for v in got.values()) and all((v[5] is None) >= (v[1] is None) for v in got.values())
    east = GridSpec("e", lat, Axis(285.0, 0.1, 5), lon_360=True)
    there = {r.id: (r.Lon, r.v) for r in habitat.sample(pts, alt, east, "v").collect()}
    assert there == {r.id: (r.Lon, r.Bathymetry) for r in once.collect()}
