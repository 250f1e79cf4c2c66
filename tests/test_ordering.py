"""Ranges of a key whose number follows from the rows, and exact order statistics without a sort."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import ordering


@pytest.fixture
def short_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "ROWS", 100)


def test_ranges_follow_the_rows(spark, short_ranges):
    """Under a fixed number of shuffle partitions ranges keep their size as the table grows, also where keys lie unevenly."""
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    for n in (90, 1000, 8000):
        df = spark.range(n).select(F.pow(F.col("id").cast("double") / n, 5.0).alias("k"))
        cut, ranges = ordering.in_ranges(df.repartition(6), "k")
        sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
        assert ranges == -(-n // 100) and abs(len(sizes) - ranges) <= 1 and max(sizes) <= 150
        edges = cut.groupBy("_block").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("_block").collect()
        assert all(x.b < y.a for x, y in zip(edges[:-1], edges[1:], strict=True))


def test_running_totals_over_ranges(spark, short_ranges):
    r = random.Random(1)
    rows = [(g, k, r.randrange(9)) for g in ("a", "b", None) for k in r.sample(range(-3000, 3000), 700)] + [("only", 5, 3)]
    got = {(x.g, x.k): x.s for x in ordering.running(spark.createDataFrame(rows, "g string, k long, c int"), "k", {"c": "s"}, by=("g",)).collect()}
    for g in ("a", "b", None, "only"):
        total = 0
        for _, k, c in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            total += c
            assert got[g, k] == total
    assert len(got) == len(rows)


def test_running_totals_by_time_with_null(spark, short_ranges):
    start = datetime.datetime(2020, 1, 1)
    rows = [(start + datetime.timedelta(hours=h), 1) for h in range(500)] + [(None, 7)]
    got = ordering.running(spark.createDataFrame(rows, "t timestamp, c int"), "t", {"c": "s"}).collect()
    assert {x.t: x.s for x in got} == {None: 7, **{t: 8 + i for i, (t, _) in enumerate(rows[:-1])}}


def test_nearest_marks_over_ranges(spark, short_ranges):
    r = random.Random(2)
    xs = r.sample(range(10_000), 900)
    rows = [(x, x if r.random() < 0.02 else None) for x in xs]
    marks = [m for _, m in rows if m is not None]
    for x in ordering.around(spark.createDataFrame(rows, "x long, m long"), "x", "m").collect():
        assert x.below == max((m for m in marks if m <= x.x), default=None) and x.above == min((m for m in marks if m >= x.x), default=None)


def test_quantiles_of_all_doubles(spark):
    """Signs, infinities, zeros of both signs, neighbours that differ in the last bit, missing values."""
    r = random.Random(3)
    near = [float(np.nextafter(1.0, 2.0) + k * 2**-52) for k in range(40)]
    a = near * 3 + [0.0, -0.0, -1e300, 1e300, 5e-324, -5e-324] + [-r.random() for _ in range(60)]
    b = [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(300)]
    c = [float("-inf"), 1.0, 2.0, float("inf")]
    n = max(map(len, (a, b, c)))
    pad = lambda x: [*x, *[None] * (n - len(x))]
    df = spark.createDataFrame(list(zip(pad(a), pad(b), pad(c), strict=True)), "a double, b double, c double").repartition(4)
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = {x.variable: x["at"] for x in ordering.quantiles(df, ["a", "b", "c"], shares).collect()}
    assert got["a"] == pytest.approx(np.quantile(a, shares).tolist(), rel=1e-15)
    assert got["b"] == pytest.approx(np.quantile(b, shares).tolist(), rel=1e-12)
    assert got["c"][0] == float("-inf") and got["c"][-1] == float("inf") and got["c"][3] == 1.5
    assert ordering.quantiles(df.limit(0), ["a"], shares).count() == 0
    with_nan = df.select(F.when(F.col("a") > 0, F.lit(float("nan"))).otherwise(F.col("a")).alias("a"))
    assert ordering.quantiles(with_nan, ["a"], [1.0]).first()["at"] == [0.0]


def test_keys_are_in_order():
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf])
    k = ordering.ordered_bits(x)
    assert (k[1:] >= k[:-1]).all() and k[4] == k[5] and [ordering.from_bits(int(v)) for v in k] == x.tolist()
