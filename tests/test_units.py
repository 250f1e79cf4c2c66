"""Operators against NumPy and plain Python on small fixtures, with NULL and NaN."""

import datetime
import http.server
import math
import os
import random
import re
import struct
import threading
import urllib.parse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import geo, scalars
from tidewright.operators import evaluate, knn, models, ordering, raster, sampling, stats
from tidewright.plans import habitat
from tidewright.schema import FINAL, SIGHTINGS, Axis
from tidewright.sources import cubes, dap, tables


def cells(spark, z, lat0=35.0, lon0=-75.0, step=0.05):
    rows = [(i, j, lat0 + step * i, lon0 + step * j, None if v != v else float(v)) for (i, j), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "lat_idx int, lon_idx int, lat double, lon double, value double")


def test_nan_is_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r.x for r in scalars.nan_to_null(df).collect()] == [1.0, None, None]
    assert [r.f for r in df.select(scalars.flag_above(F.col("x"), 0.5).alias("f")).collect()] == [True, False, False]
    assert [r.f for r in df.select(scalars.patch(F.col("x"), F.lit(7.0)).alias("f")).collect()] == [1.0, 7.0, 7.0]
    assert [r.f for r in df.select(scalars.patch(F.lit(2.0), F.col("x")).alias("f")).collect()] == [2.0] * 3
    assert [r.f for r in scalars.nan_to_null(df).select(scalars.outside(F.col("x"), 2, 3).alias("f")).collect()] == [True, False, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("27-Jan-18", "2018-01-27"), ("27-JAN-18", "2018-01-27"), ("2018-01-27", "2018-01-27"), ("03/04/2018", "2018-04-03"),
        ("5-Mar-99", "1999-03-05"), ("01-JAN-69", "1969-01-01"), ("01-JAN-68", "2068-01-01"), ("3/4/18", "2018-04-03"), ("nonsense", None),
        ("", None), (None, None)
    ],
)
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(scalars.parse_date(F.col("t")).alias("d")).first().d
    assert got == (None if want is None else datetime.datetime.fromisoformat(want))


def test_month_key_keeps_the_time(spark):
    r = spark.createDataFrame(
        [(datetime.datetime(2018, 1, 31, 5),), (datetime.datetime(2018, 2, 1),)], "d timestamp"
    ).select(scalars.month_key(F.col("d")).alias("m")).collect()
    assert [x.m for x in r] == [datetime.datetime(2018, 1, 16, 5), datetime.datetime(2018, 2, 16)]


@pytest.mark.parametrize("shape", [(6, 5), (1, 5), (2, 2), (4, 1)])
def test_gradient(spark, shape):
    z = np.random.default_rng(1).normal(size=shape)
    if shape == (6, 5):
        z[2, 3] = np.nan
    got = {(r.lat_idx, r.lon_idx): r.gradient for r in raster.gradient(cells(spark, z), 0.05, 0.05).collect()}
    if 1 in shape:
        assert set(got.values()) == {None}
        return
    mean = 35.0 + 0.05 * (shape[0] - 1) / 2
    gy, gx = np.gradient(z, geo.KM_PER_DEGREE * 0.05, geo.KM_PER_DEGREE * 0.05 * math.cos(math.radians(mean)))
    for k, w in np.ndenumerate(np.hypot(gy, gx)):
        assert got[k] is None if w != w else got[k] == pytest.approx(w, rel=1e-9)


def test_nearest_prefers_the_larger_of_two(spark):
    z = np.arange(12.0).reshape(3, 4)
    p = spark.createDataFrame([(35.025, -75.0), (34.0, -80.0), (99.0, 99.0), (None, -75.0)], "Lat double, Lon double")
    axis = Axis(0.0, 1.0, 4)
    halves = spark.createDataFrame([(0.5, 1.5), (-3.0, 9.0)], "a double, b double").select(
        raster.nearest_index(F.col("a"), axis).alias("a"), raster.nearest_index(F.col("b"), axis).alias("b")
    ).collect()
    assert [tuple(r) for r in halves] == [(1, 2), (0, 3)]
    got = {(r.Lat, r.Lon): r.v for r in raster.sample_nearest(p, cells(spark, z), Axis(35.0, 0.05, 3), Axis(-75.0, 0.05, 4), "v").collect()}
    assert got[34.0, -80.0] == 0.0 and got[99.0, 99.0] == 11.0 and got[None, -75.0] is None


def test_bilinear(spark):
    z = np.random.default_rng(2).normal(size=(5, 6))
    z[4, 5] = np.nan
    r = random.Random(1)
    pts = [(k, 35 + r.random() * 0.2, -75 + r.random() * 0.25) for k in range(60)] + [
        (100, 35.2, -75.0), (101, 34.99, -75.0), (102, None, None), (103, 35.0, -75.0)
    ]
    df = spark.createDataFrame(pts, "id long, Lat double, Lon double")
    got = {r.id: r.v for r in raster.sample_bilinear(df, cells(spark, z), Axis(35.0, 0.05, 5), Axis(-75.0, 0.05, 6), "v").collect()}
    for k, lat, lon in pts:
        y, x = ((lat - 35.0) / 0.05, (lon + 75.0) / 0.05) if lat is not None else (-1, -1)
        if not (0 <= y <= 4 and 0 <= x <= 5):
            assert got[k] is None
            continue
        i, j = min(int(y), 3), min(int(x), 4)
        w = (1 - y + i) * ((1 - x + j) * z[i, j] + (x - j) * z[i, j + 1]) + (y - i) * ((1 - x + j) * z[i + 1, j] + (x - j) * z[i + 1, j + 1])
        assert got[k] is None if w != w else got[k] == pytest.approx(w, abs=1e-9)


def test_nearest_time(spark):
    at = lambda *x: datetime.datetime(2018, *x)
    p = spark.createDataFrame([(1, at(1, 1)), (2, at(1, 4)), (3, at(1, 2)), (4, at(6, 1)), (5, None), (6, at(1, 3))], "id int, key timestamp")
    t = spark.createDataFrame([(at(1, 2),), (at(1, 4),), (at(1, 6),)], "time timestamp")
    assert {r.id: r.time for r in raster.nearest_time(p, t).collect()} == {1: at(1, 2), 2: at(1, 4), 3: at(1, 2), 4: at(1, 6), 5: None, 6: at(1, 4)}
    assert {r.id: r.time for r in raster.nearest_time(p, t, tolerance_s=86400).collect()}[4] is None
    assert {r.time for r in raster.nearest_time(p, t.limit(0)).collect()} == {None}


@pytest.mark.parametrize("tile", [1.0, 8.0, 500.0])
@pytest.mark.parametrize("layout", ["spread", "clustered", "one", "ties"])
def test_nearest_cell(spark, tile, layout):
    r = random.Random(layout)
    pts = [(k, 30 + r.random() * 10, -75 + r.random() * 10) for k in range(80)]
    cs = {
        "spread": [(k, 30 + r.random() * 10, -75 + r.random() * 10) for k in range(120)],
        "clustered": [(k, 39 + r.random() * 0.1, -66 + r.random() * 0.1) for k in range(25)], "one": [(7, 60.0, 100.0)],
        "ties": [(k, 35.0, -70.0) for k in (5, 3, 9)]
    }[layout]
    mean = sum(p[1] for p in pts) / len(pts)
    c = math.cos(math.radians(mean))
    got = {
        r.id: r.km for r in knn.nearest_cell(
            spark.createDataFrame([*pts, (999, None, 0.0)], "id long, Lat double, Lon double"),
            spark.createDataFrame(cs, "cell_id long, lat double, lon double"), "km", tile
        ).collect()
    }
    assert got.pop(999) is None
    for k, lat, lon in pts:
        _, b, l = min(cs, key=lambda x: (((x[1] - lat) ** 2 + ((x[2] - lon) * c) ** 2), x[0]))
        a = math.sin(math.radians(b - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(b)) * math.sin(math.radians(l - lon) / 2) ** 2
        assert got[k] == pytest.approx(2 * 6371 * math.asin(math.sqrt(a)), rel=1e-9)


@pytest.mark.parametrize("south", [80, 200, 230])
def test_nearest_cell_beyond_a_pole(spark, south):
    """Rasters of made-up tables go on beyond 90 degrees, where the cosine of the mean latitude is negative."""
    r = random.Random(south)
    pts = [(k, south + r.random() * 60, -75 + r.random() * 2.5) for k in range(60)]
    cs = [(k, south + r.random() * 60, -75 + r.random() * 2.5) for k in range(90)]
    c = math.cos(math.radians(sum(p[1] for p in pts) / len(pts)))
    cells_ = spark.createDataFrame(cs, "cell_id long, lat double, lon double")
    near = lambda p: min(cs, key=lambda x: (((x[1] - p[1]) ** 2 + ((x[2] - p[2]) * c) ** 2), x[0]))[0]
    got = knn.nearest_cell(
        spark.createDataFrame(pts, "id long, Lat double, Lon double"), cells_.withColumn("number", F.col("cell_id")), "km", keep=("number",)
    )
    assert c < 0 and {x.id: x.number for x in got.collect()} == {p[0]: near(p) for p in pts}


@pytest.mark.parametrize("most", [4096, 3, 0])
def test_nearest_cells_of_several_sets(spark, monkeypatch, tmp_path, most):
    """All sets in one pass over points that keep their columns, however many cells a tile's pairs have; only what the result reads stays written."""
    monkeypatch.setattr(knn, "MOST_IN_ROW", most)
    r = random.Random(7)
    pts = [(k, 30 + r.random() * 10, -75 + r.random() * 10, f"p{k}") for k in range(150)] + [(998, None, -70.0, "no"), (999, 35.0, None, "no")]
    cells = [(k, 30 + r.random() * 10, -75 + r.random() * 10) for k in range(400)]
    near = [(k, 39 + r.random() * 0.1, -66 + r.random() * 0.1) for k in range(40)]
    frame = lambda x: spark.createDataFrame(x, "cell_id long, lat double, lon double")
    points = spark.createDataFrame(pts, "id long, Lat double, Lon double, name string")
    points.repartition(3).write.parquet(f"file://{tmp_path}/points")
    mark = tables.named()
    got = knn.nearest_cells(spark.read.parquet(f"file://{tmp_path}/points"), {"a": frame(cells), "none": frame([]), "b": frame(near)})
    assert got.columns[:4] == points.columns
    left = [p for p in tables._mine.paths[mark:] if os.path.exists(p.removeprefix("file://"))]
    assert len(left) == (1 if most == 4096 else 3)  # the lists, and with crowded tiles what they are made of
    rows = {x.id: x for x in got.collect()}
    assert len(rows) == len(pts) and all(x.none is None for x in rows.values()) and rows[998].a is rows[999].b is None
    c = math.cos(math.radians(sum(p[1] for p in pts[:150]) / 150))
    for k, lat, lon, name in pts[:150]:
        for out, cs in (("a", cells), ("b", near)):
            _, b, l = min(cs, key=lambda x: (((x[1] - lat) ** 2 + ((x[2] - lon) * c) ** 2), x[0]))
            h = math.sin(math.radians(b - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(b)) * math.sin(math.radians(l - lon) / 2) ** 2
            assert rows[k][out] == pytest.approx(2 * 6371 * math.asin(math.sqrt(h)), rel=1e-9) and rows[k].name == name


def test_chain_deletes_what_led_to_its_result(spark):
    """Of all that the chain writes on its way, the table of sampled points and the lists of cells stay until the result has been taken."""
    from tidewright.plans import more_queries

    mark, before = tables.named(), spark.conf.get(tables._TIDY)
    out = more_queries.habitat_features(spark, "/root/testdata/sf0.001")
    left = [os.path.basename(p).split("-")[0] for p in tables._mine.paths[mark:] if os.path.exists(p.removeprefix("file://"))]
    assert sorted(left) == ["lists", "sampled"] and out.count() > 1000 and spark.conf.get(tables._TIDY) == before


def test_nearest_cell_without_cells(spark):
    p = spark.createDataFrame([(1, 35.0, -75.0)], "id long, Lat double, Lon double")
    assert knn.nearest_cell(p, spark.createDataFrame([], "cell_id long, lat double, lon double"), "km").first().km is None


def test_annulus_distance(spark):
    p = spark.range(3000).select(
        F.col("id"), (F.col("id") % 120 - 60).cast("double").alias("Lat"), (F.col("id") % 350 - 175).cast("double").alias("Lon")
    )
    ring = sampling.ring_points(p, range(3)).withColumnsRenamed({"Lat": "y", "Lon": "x"}).join(p, "id")
    d = ring.select(geo.haversine_km(F.col("Lat"), F.col("Lon"), F.col("y"), F.col("x")).alias("d")).agg(F.min("d"), F.max("d"), F.avg("d")).first()
    assert 14.99 < d[0] and d[1] < 300.01 and 190 < d[2] < 210


def test_pseudo_absences(spark):
    z = np.where(np.arange(400).reshape(20, 20) % 3 == 0, -5.0, 5.0)
    z[:, :3] = 5.0
    p = spark.range(40).select(
        "id", (35 + F.col("id") % 20 * 0.05).alias("Lat"), F.lit(-74.5).alias("Lon"), F.current_timestamp().alias("Date"), F.lit(1).alias("Presence")
    )
    args = (cells(spark, z), Axis(35.0, 0.05, 20), Axis(-75.0, 0.05, 20))
    key = lambda df: sorted((r.id, r.attempt, r.Lat, r.Lon) for r in df.collect())
    a = key(sampling.pseudo_absences(p, *args, attempts=40, outer_km=40.0))
    assert a == key(sampling.pseudo_absences(p.repartition(5), *args, attempts=40, outer_km=40.0, most_bytes=0))
    assert max(pd.Series([x[0] for x in a]).value_counts()) <= 4
    dry = cells(spark, np.full((20, 20), 5.0))
    assert sampling.pseudo_absences(p, dry, *args[1:], attempts=5).count() == 0


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    assert sampling.fixed_sample(df, 50).collect() == sampling.fixed_sample(df.repartition(9), 50).collect()


@pytest.mark.parametrize("q", [4, 8, 10])
def test_quantile_bins_equal_pandas(spark, q):
    r = random.Random(q)
    x = [float(r.choice([1, 1, 1, 2, 3.5, r.random() * 5])) for _ in range(300)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)] + [(999, None)], "id long, x double")
    got = {r.id: r.bin for r in stats.quantile_bins(df, "x", q).collect()}
    want = pd.qcut(pd.Series(x), q, labels=False, duplicates="drop")
    assert got.pop(999) is None and [got[k] for k in range(300)] == want.astype(int).tolist()


def test_rank_test(spark):
    r = random.Random(3)
    rows = [(float(r.randrange(20)) + y, y) for y in [1] * 40 + [0] * 70] + [(None, 1)]
    got = stats.rank_test(spark.createDataFrame(rows, "x double, Presence int"), "x").first()
    a, b = [v for v, y in rows if y and v is not None], [v for v, y in rows if not y]
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    assert (got.n1, got.n0, got.u) == (40, 70, u) and got.r == pytest.approx(1 - 2 * u / 2800)
    one = stats.rank_test(spark.createDataFrame([(1.0, 1)], "x double, Presence int"), "x").first()
    assert one.r is None


def test_running_totals(spark):
    r = random.Random(4)
    rows = [(float(k), r.randrange(5)) for k in r.sample(range(100_000), 3000)]
    got = {x.k: x.s for x in ordering.running(spark.createDataFrame(rows, "k double, c int"), "k", {"c": "s"}).collect()}
    total = 0
    for k, c in sorted(rows):
        total += c
        assert got[k] == total
    assert ordering.running(spark.createDataFrame([], "k double, c int"), "k", {"c": "s"}).count() == 0


def test_curve_and_threshold(spark):
    r = random.Random(5)
    rows = [(k, round(r.random(), 2), int(r.random() < 0.3)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    want = []
    p, n = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
    for t in sorted({s for _, s, _ in rows}):
        tp, fp = sum(y for _, s, y in rows if s >= t), sum(1 - y for _, s, y in rows if s >= t)
        want.append((t, tp, fp, fp / n, tp / p, tp / (tp + fp)))
    got = sorted((x.threshold, x.tp, x.fp, x.fpr, x.tpr, x.precision) for x in evaluate.curve(df).collect())
    assert got == [pytest.approx(w) for w in want]
    best = max((w for w in want if w[4] >= 0.8), key=lambda w: (w[5], -w[0]))
    assert evaluate.choose_threshold(evaluate.curve(df)).first().threshold == best[0]
    far = spark.createDataFrame([(0.5, 0.9, 0.3), (0.4, 0.2, 0.6)], "threshold double, precision double, recall double")
    assert evaluate.choose_threshold(far).first().threshold == 0.4
    auc = sum((a > b) + 0.5 * (a == b) for _, a, x in rows if x for _, b, y in rows if not y) / (p * n)
    assert evaluate.auc(df).first().auc == pytest.approx(auc)
    assert evaluate.auc(df.where("label = 1")).first().auc is None
    assert evaluate.metrics(evaluate.confusion(df.limit(0), 0.5)).first().f1 == 0.0


def test_temporal_split(spark):
    rows = [(k, datetime.datetime(2020, 1, 1 + k % 7)) for k in range(53)]
    df = spark.createDataFrame(rows, "id long, Date timestamp").repartition(4)
    order = [k for _, k in sorted((d, k) for k, d in rows)]
    got = {r.id: r.is_train for r in evaluate.temporal_split(df).collect()}
    assert [got[k] for k in order] == [True] * 42 + [False] * 11
    whole = evaluate.temporal_split(df, by_date=True).groupBy("Date").agg(F.countDistinct("is_train").alias("n")).collect()
    assert {r.n for r in whole} == {1}


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert stats.correlations(df, ["a", "b"]).first().r is None
    assert stats.histogram(df, "a").agg(F.sum("n")).first()[0] == 2


def test_logistic_equals_newton(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.3] + g.normal(size=400) > 0.4).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, Presence int")
    m = models.fit_logistic(df, ["a", "b", "c"])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    z, w = np.hstack([x, np.ones((400, 1))]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.array([1, 1, 1, 0.0])
        w -= np.linalg.solve((z.T * (s * p * (1 - p))) @ z + np.diag(ridge), z.T @ (s * (p - y)) + ridge * w)
    assert [*m.coefficients, m.intercept] == pytest.approx(w.tolist(), abs=1e-5)


def test_kernel_pca(spark):
    g = np.random.default_rng(7)
    x = np.vstack([g.normal(size=(40, 2)), g.normal(size=(40, 2)) + 3])
    df = spark.createDataFrame([(k, *map(float, r), int(k >= 40)) for k, r in enumerate(x)], "id long, a double, b double, Presence int")
    got = models.kernel_pca(df, ["a", "b"], 0.1).toPandas().sort_values("id")
    k = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    v, e = np.linalg.eigh(k)
    for c, i in (("pc1", -1), ("pc2", -2)):
        want = e[:, i] * np.sqrt(v[i])
        assert min(np.abs(got[c] - want).max(), np.abs(got[c] + want).max()) < 1e-6
    with pytest.raises(ValueError):
        models.kernel_pca(df, ["a", "b"], most=10)
    axes = models.kernel_pca(df, ["a", "b"]).join(df.select("id", "Presence"), "id")
    assert models.separability(axes).first().verdict == "strong"


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [1]

    assert cubes.with_retries(flaky, sleep=waits.append) == [1] and waits == [5.0, 10.0]
    assert cubes.with_retries(lambda: 1 / 0, sleep=lambda s: None) is None


def test_failed_slab_leaves_the_others(spark):
    got = cubes.read_cube(spark, "tests.test_rasters:broken", ["1", "2", "3"], tries="1").groupBy("time").count().collect()
    assert [r["count"] for r in got] == [400, 400]


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("SIGHTINGDATE,LAT,LON\n27-Jan-18,40.5,NaN\n,41.0,-70\n2018-01-27,,-70\n")
    got = tables.read_csv(spark, str(tmp_path / "s.csv"), SIGHTINGS).collect()
    assert [tuple(r) for r in got] == [("27-Jan-18", 40.5, None), (None, 41.0, -70.0), ("2018-01-27", None, -70.0)]
    with pytest.raises(SystemExit):
        tables.required(lambda: tables.read_csv(spark, str(tmp_path / "no.csv"), SIGHTINGS), "sightings")
    assert tables.read_threshold(spark, str(tmp_path / "none.txt")).first().threshold == 0.5


def test_final_schema_has_the_features():
    from tidewright.schema import FEATURE_ORDER

    assert set(FEATURE_ORDER) <= {f.name for f in FINAL}


def test_large_ids(spark):
    """Draws reduce the id first: any 64-bit id works."""
    df = spark.createDataFrame([(i,) for i in (1, 2**40, 2**62, 2**63 - 1)], "id long")
    got = df.select(sampling.uniform(F.col("id"), F.lit(3), 42).alias("u")).collect()
    assert all(0 <= r.u < 1 for r in got) and sampling.fixed_sample(df, 2).count() == 2
    small = spark.range(50).select(
        sampling.uniform(F.col("id"), F.lit(2), 7).alias("u"), F.expr(sampling.uniform_sql("id", "2", 7)).cast("double").alias("s")
    )
    assert all(r.u == pytest.approx(r.s) for r in small.collect())


def test_clean_sightings(spark):
    rows = [
        ("27-Jan-18", 40.5, -70.0), ("27-Jan-18", 40.5, -70.0), ("2018-01-27", 40.5, -70.0), ("03/04/2018", 41.0, -70.0), (None, 41.0, -70.0),
        ("2018-01-27", None, -70.0)
    ]
    df = spark.createDataFrame(rows, SIGHTINGS)
    got = sorted(tuple(r) for r in habitat.clean_sightings(df).collect())
    assert len(got) == 4 == len({r[0] for r in got}) and all(0 <= r[0] < 2**63 and r[4] == 1 for r in got)
    assert got == sorted(tuple(r) for r in habitat.clean_sightings(df.repartition(5)).collect())  # reruns agree, however the rows are dealt


def test_background_ids(spark):
    p = spark.range(60).select(
        (F.col("id") + 2**62).alias("id"), F.lit(35.4).alias("Lat"), F.lit(-74.5).alias("Lon"), F.current_timestamp().alias("Date"),
        F.lit(1).alias("Presence")
    )
    got = habitat.with_background(
        p, cells(spark, np.full((20, 20), -5.0)), Axis(35.0, 0.05, 20), Axis(-75.0, 0.05, 20), attempts=8, inner_km=1.0, outer_km=10.0
    ).collect()
    assert len(got) == 60 * 5 == len({r.id for r in got})


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.1, 0.25, 0.9, 1.0]])
def test_exact_quantiles(spark, shares):
    r = random.Random(11)
    a, b = [float(r.choice([1, 2, 2, 7, r.random()])) for _ in range(501)], [r.random() for _ in range(400)]
    df = spark.createDataFrame([(a[k], b[k] if k < 400 else None, None) for k in range(501)], "a double, b double, c double").repartition(5)
    got = {x.variable: x["at"] for x in ordering.quantiles(df, ["a", "b", "c"], shares).collect()}
    assert set(got) == {"a", "b"}  # a column without values has none
    assert got["a"] == pytest.approx(np.quantile(a, shares).tolist()) and got["b"] == pytest.approx(np.quantile(b, shares).tolist())


def test_running_totals_in_groups(spark):
    r = random.Random(12)
    rows = [(g, float(k), r.randrange(9)) for g in ("a", "b") for k in r.sample(range(10_000), 700)]
    got = {(x.g, x.k): x.s for x in ordering.running(spark.createDataFrame(rows, "g string, k double, c int"), "k", {"c": "s"}, by=("g",)).collect()}
    for g in ("a", "b"):
        total = 0
        for _, k, c in sorted(x for x in rows if x[0] == g):
            total += c
            assert got[g, k] == total


def test_two_sided_p(spark):
    z = [0.0, 0.1, 1.0, 1.96, 3.0, 4.2, 4.3, 8.0, 30.0, -2.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.two_sided_p(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(max(r.z, 0.0) / math.sqrt(2)), rel=1e-7)


def test_bin_labels(spark):
    assert spark.range(1).select(
        stats.bin_label(F.lit(1.234), F.lit(-5.0)).alias("l"), stats.bin_label(F.lit(1.2), F.lit(5.0), 0).alias("m")
    ).first().asDict() == {"l": "1.23--5.00", "m": "1-5"}


def test_source_that_fails_at_run_time(spark):
    df = spark.range(3)
    broken = lambda d: d.withColumn("x", F.raise_error(F.lit("SourceError: gone")).cast("double"))
    assert {r.x for r in tables.optional(df, broken, "x", run=True).collect()} == {None}
    assert {r.x for r in tables.optional(df, lambda d: d.withColumn("x", F.lit(1.0)), "x", run=True).collect()} == {1.0}


def test_report(spark, caplog):
    with caplog.at_level("INFO", "tidewright"):
        assert tables.report(spark.range(2), "two rows").count() == 2
    assert "two rows" in caplog.text


def test_scratch_is_deleted(spark):
    path = tables.scratch(spark, "gone")
    tables.stage(spark.range(1), path)
    tables._written[:] = [x for x in tables._written if x[1] == path]
    tables.release()
    assert not os.path.exists(path.removeprefix("file://"))


class Dap(http.server.BaseHTTPRequestHandler):
    """A server of one small raster (time, lat descending, lon) with a fill value and a scale."""

    axes = {"time": [0.0, 1.0], "lat": [37.0, 36.5, 36.0, 35.5], "lon": [-75.0, -74.5, -74.0]}
    calls: list[str] = []

    def do_GET(self):
        path, _, query = self.path.partition("?")
        query = urllib.parse.unquote(query)
        Dap.calls.append(self.path)
        if len(Dap.calls) == 1:  # the first request fails: retried
            return self.send_error(503)
        values = np.arange(24, dtype=float).reshape(2, 4, 3)
        values[1, 2, 1] = -999
        declared = lambda name, shape, kind="Float64": f"    {kind} {name}" + "".join(f"[{d} = {n}]" for d, n in shape) + ";\n"
        if path.endswith(".dds"):
            body = ("Dataset {\n" + declared("sst", [(d, len(v)) for d, v in self.axes.items()], "Float32") + "} x;\n").encode()
        elif path.endswith(".das"):
            body = b'Attributes {\n  time { String units "days since 2020-01-01 09:00:00"; }\n  sst { Float32 _FillValue -999; Float32 scale_factor 0.5; Float32 add_offset 1; }\n}\n'
        elif query.startswith("sst"):
            part = values[tuple(slice(int(a), int(z) + 1) for a, z in re.findall(r"\[(\d+):1:(\d+)\]", query))]
            head = "Dataset {\n" + declared("sst", list(zip(self.axes, part.shape)), "Float32") + "} x;\nData:\n"  # noqa: B905
            body = head.encode() + struct.pack(">II", part.size, part.size) + part.astype(">f4").tobytes()
        else:
            names = query.split(",")
            head = "Dataset {\n" + "".join(declared(n, [(n, len(self.axes[n]))]) for n in names) + "} x;\nData:\n"
            body = head.encode() + b"".join(
                struct.pack(">II", len(self.axes[n]), len(self.axes[n])) + np.array(self.axes[n], ">f8").tobytes() for n in names
            )
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_dap_server(spark):
    """A raster behind a server: only the box asked for is sent; the first answer is an error and is tried again."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Dap)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/sst"
        cube = cubes.read_cube(spark, "tidewright.sources.dap:open_slab", [f"{url}|sst|0|", f"{url}|sst|1|"], wait_s="0")
        got = {(r.time.day, r.lat_idx, r.lon_idx): (r.lat, r.lon, r.value) for r in cubes.slab(cube, (35.9, 36.6), (-74.6, -70.0)).collect()}
    finally:
        server.shutdown()
    assert len(got) == 8 and got[2, 1, 1] == (36.0, -74.5, None) and got[1, 2, 2] == (36.5, -74.0, 5 * 0.5 + 1)
    assert any("[1:1:2][1:1:2]" in urllib.parse.unquote(c) for c in Dap.calls)
    assert cubes.with_retries(lambda: dap.open_slab(f"{url}|sst|0|", {}), tries=1) is None


def test_density_within_its_bound(spark):
    """All rows, correlated and uneven, against the plain sum; far points and one line of points."""
    g = np.random.default_rng(9)
    u = np.r_[g.normal(size=700), 3 + 0.1 * g.normal(size=300)]
    v = 0.6 * u + g.normal(size=1000) * 0.7
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, v, strict=True)] + [(None, 1.0)], "u double, v double").repartition(5)
    c = np.cov(u, v) * 1000 ** (-1 / 3)
    i, j = np.divmod(np.arange(400), 20)
    at = np.stack([u.min() + (u.max() - u.min()) * i / 19, v.min() + (v.max() - v.min()) * j / 19])
    d = at[:, :, None] - np.stack([u, v])[:, None, :]
    peak = 1 / (2 * math.pi * math.sqrt(np.linalg.det(c)))
    want = np.exp(-np.einsum("iab,ij,jab->ab", d, np.linalg.inv(c), d) / 2).mean(1) * peak
    got = {r.cell: (r.x, r.y, r.density) for r in stats.kde_2d(df, "u", "v").collect()}
    assert len(got) == 400 and stats.kde_2d_error() < 2e-7
    for k in range(400):
        assert got[k][:2] == pytest.approx(at[:, k].tolist()) and abs(got[k][2] - want[k]) <= stats.kde_2d_error() * peak
    line = spark.createDataFrame([(float(k), 2.0 * k) for k in range(9)], "u double, v double")
    assert {r.density for r in stats.kde_2d(line, "u", "v").collect()} == {None}
    assert stats.kde_2d(df.limit(0), "u", "v").count() == 0


def test_only_a_sources_failures_are_passed_over(spark):
    df = spark.range(3)
    missing = tables.optional(df, lambda d: d.join(spark.read.parquet("/no/such/raster"), "id"), "x")
    assert [r.x for r in missing.collect()] == [None] * 3
    fails = lambda text: lambda d: d.withColumn("x", F.raise_error(F.lit(text)).cast("double"))
    assert [r.x for r in tables.optional(df, fails("SourceError: no answer"), "x", run=True).collect()] == [None] * 3
    with pytest.raises(Exception, match="a bug"):
        tables.optional(df, fails("a bug"), "x", run=True)
    with pytest.raises(Exception, match="nowhere"):
        tables.optional(df, lambda d: d.select("nowhere"), "x")
    with pytest.raises(ZeroDivisionError):
        tables.optional(df, lambda d: 1 / 0, "x")


def test_attempts_stay_within_twice_those_needed():
    """The waves double: whatever the number of attempts that a point needs, no more than twice as many are made, or the first wave."""
    for each in (1, 4):
        tried = sampling.waves(each, 201)
        assert [a.start for a in tried] == [0, *[a.stop for a in tried[:-1]]] and tried[-1].stop == 201
        for needed in range(each, 202):
            made = next(a.stop for a in tried if a.stop >= needed)
            assert made <= max(2 * each, 2 * needed + each)


def test_absences_of_odd_presences(spark):
    """Points without an id or a place have none; large and negative ids, names of its own columns, a mask with gaps; both ways agree."""
    z = np.random.default_rng(3).normal(size=(30, 40))
    z[5, 5:20] = np.nan
    grid = cells(spark, z).where("lat_idx <> 9")
    rows = [(2**62, 35.7, -74.1, 1, "x"), (-5, 35.2, -73.3, 1, None), (None, 35.5, -74.0, 1, "y"), (8, None, -74.0, 1, "z"), (9, 36.4, -75.0, 1, "w")]
    p = spark.createDataFrame(rows, "id long, Lat double, Lon double, Presence int, note string")
    args = (grid, Axis(35.0, 0.05, 30), Axis(-75.0, 0.05, 40))
    key = lambda df: sorted((r.id, r.attempt, r.Lat, r.Lon, r.note or "", r.Presence) for r in df.collect())
    one = key(sampling.pseudo_absences(p, *args, each=3, attempts=50, outer_km=60.0))
    assert one == key(sampling.pseudo_absences(p, *args, each=3, attempts=50, outer_km=60.0, most_bytes=0)) and {r[0] for r in one} == {2**62, -5, 9}
    assert sampling.pseudo_absences(p.limit(0), *args).count() == 0


def test_cells_are_counted_before_they_meet_days(spark):
    """Otherwise the product of cells and days is made row by row."""
    from tidewright.plans import more_queries

    plan = more_queries.needed_slices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    product = plan.index("Join Inner") if "Join Inner" in plan else plan.index("Join Cross")
    assert re.search(r"Aggregate \[value#", plan[product:])
