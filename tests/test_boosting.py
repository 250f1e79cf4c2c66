"""Boosted trees against a booster of plain loops, with missing values."""

import math

import numpy as np
import pytest

from tidewright.operators import boosting
from tidewright.operators.boosting import Settings


def grow(x, y, edges, how):
    """Trees as nested lists: (column, threshold, missing_left, gain, left, right) or a leaf's value."""
    weight = (y == 0).sum() / (y == 1).sum()
    w = np.where(y == 1, weight, 1.0)
    margin, trees = np.zeros(len(y)), []
    score = lambda g, h: max(abs(g) - how.l1, 0.0) ** 2 / (h + how.l2)

    def node(rows, depth, g, h):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        if depth < how.depth:
            for c in range(x.shape[1]):
                v = x[rows, c]
                for e in edges[c]:
                    if not (v[~np.isnan(v)] <= e).any():
                        continue
                    for missing_left in (False, True):
                        left = rows[(v <= e) | (np.isnan(v) & missing_left)]
                        lg, lh = g[left].sum(), h[left].sum()
                        gain = score(lg, lh) + score(G - lg, H - lh) - score(G, H)
                        if min(lh, H - lh) >= how.least_weight and gain > max(how.split_penalty, 1e-6) and (best is None or gain > best[0] + 1e-9):
                            best = gain, c, e, missing_left, left
        if best is None:
            value = -how.step * math.copysign(max(abs(G) - how.l1, 0), G) / (H + how.l2)
            margin[rows] += value
            return value
        gain, c, e, missing_left, left = best
        right = np.setdiff1d(rows, left)
        return c, e, missing_left, gain, node(left, depth + 1, g, h), node(right, depth + 1, g, h)

    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        trees.append(node(np.arange(len(y)), 0, w * (p - y), w * p * (1 - p)))
    return trees, 1 / (1 + np.exp(-margin))


def nested(f, t, i=0):
    if f.column[t, i] < 0:
        return f.value[t, i]
    return int(f.column[t, i]), f.threshold[t, i], bool(f.missing_left[t, i]), f.gain[t, i], nested(f, t, 2 * i + 1), nested(f, t, 2 * i + 2)


def same(a, b, edges):
    if isinstance(a, float) or isinstance(b, float):
        assert a == pytest.approx(b, abs=1e-6)
        return
    assert a[0] == b[0] and a[2] == b[2] and a[3] == pytest.approx(b[3], abs=1e-5)
    assert a[1] == b[1] or (math.isinf(a[1]) and b[1] == edges[b[0]][-1])
    same(a[4], b[4], edges)
    same(a[5], b[5], edges)


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(2000, 4)).round(2)
    x[:, 3] = g.integers(0, 3, 2000)
    x[g.random((2000, 4)) < 0.15] = np.nan
    p = np.nan_to_num(x[:, 0], nan=1.5) - 0.5 * np.nan_to_num(x[:, 1]) ** 2 + (x[:, 3] == 1) + np.isnan(x[:, 2])
    y = (p + g.normal(size=2000) > 1.2).astype(int)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, Presence int")


COLUMNS = ["a", "b", "c", "d"]


def test_equals_plain_loops(spark, data):
    x, y, df = data
    how = Settings(trees=4, depth=4, step=0.3, row_share=1.0, column_share=1.0, bins=32, write_every=3)
    edges = boosting.cut_points(df, COLUMNS, how.bins)
    want, scores = grow(x, y, edges, how)
    got = boosting.fit_forest(df.repartition(5), COLUMNS, how=how, edges=edges)
    for t in range(how.trees):
        same(nested(got, t), want[t], edges)
    scored = {r.id: r.score for r in boosting.add_scores(got, df).select("id", "score").collect()}
    assert [scored[i] for i in range(2000)] == pytest.approx(scores.tolist(), abs=1e-6)
    assert any(got.missing_left[got.column >= 0]) and not all(got.missing_left[got.column >= 0])  # both sides are learned


def test_same_trees_however_rows_are_dealt(spark, data):
    df, how = data[2], Settings(trees=3, depth=3, write_every=2)
    from pyspark.sql import functions as F

    edges = boosting.cut_points(df, COLUMNS, how.bins)
    a, b = (boosting.fit_forest(d, COLUMNS, how=how, edges=edges, key=F.col("id")) for d in (df.coalesce(1), df.repartition(7)))
    assert boosting.nodes(a, spark).collect() == boosting.nodes(b, spark).collect()


def test_levels_take_one_job_each_and_former_blocks_go(spark, data):
    """A level is one job without an exchange, of two children one is counted, rows of a single partition are dealt to all tasks, and no block stays behind."""
    import os

    rows, how = data[2].coalesce(1), Settings(trees=4, depth=3, write_every=2)
    edges = boosting.cut_points(rows, COLUMNS, how.bins)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    blocks = lambda: {f for f in os.listdir(shared) if f.startswith("blocks-")} if os.path.isdir(shared) else set()
    before, counted, sums = blocks(), [], boosting._sums

    def watch(b, tasks, run, nodes, use):
        counted.append(len(nodes))
        assert b.rdd.getNumPartitions() == tasks == 4 and len(blocks() - before) == 1
        return sums(b, tasks, run, nodes, use)

    spark.sparkContext.setJobGroup("levels", "levels")
    boosting.BLOCK, old, boosting._sums = 100, boosting.BLOCK, watch
    try:
        small = boosting.fit_forest(rows, COLUMNS, how=how, edges=edges)
    finally:
        boosting.BLOCK, boosting._sums = old, sums
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("levels")
    assert len(jobs) <= how.trees * how.depth + 8  # rows are counted, and blocks written twice
    assert all(n <= max(1, 2 ** (k % how.depth) // 2) for k, n in enumerate(counted)) and len(counted) == how.trees * how.depth
    assert blocks() == before
    whole = boosting.fit_forest(rows, COLUMNS, how=Settings(trees=4, depth=3, write_every=1), edges=edges)
    assert boosting.nodes(small, spark).collect() == boosting.nodes(whole, spark).collect()
    boosting.MOST_SENT, old = 0, boosting.MOST_SENT  # sums of many tasks are added up before
    try:
        assert boosting.nodes(boosting.fit_forest(rows, COLUMNS, how=how, edges=edges), spark).collect() == boosting.nodes(whole, spark).collect()
    finally:
        boosting.MOST_SENT = old


def test_scores_over_own_thresholds_are_those_of_plain_steps(spark, data):
    """Scoring compares a row once with each column's thresholds; a forest of more thresholds than a byte holds takes plain steps."""
    x, _, df = data
    f = boosting.fit_forest(df, COLUMNS, how=Settings(trees=6, depth=4))
    want = 1 / (1 + np.exp(-f.margins(x)))
    got = [r.score for r in boosting.add_scores(f, df).orderBy("id").collect()]
    assert f.cuts() is not None and got == pytest.approx(want.tolist(), abs=1e-12)
    many = boosting.Forest.empty(COLUMNS, 300, 1)
    many.column[:, 0], many.threshold[:, 0], many.value[:, 1] = 0, np.linspace(-3, 3, 300), 0.01
    assert many.cuts() is None
    got = [r.score for r in boosting.add_scores(many, df).orderBy("id").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-many.margins(x)))).tolist(), abs=1e-12)


def test_rows_and_columns_are_drawn_once_a_tree(spark):
    from pyspark.sql import functions as F

    from tidewright.operators.sampling import uniform

    keys = [-(2**62), -1, 0, 1, 17, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for tree in (0, 5):
        want = [r[0] for r in df.select(uniform(F.col("k"), F.lit(tree), 42) < 0.5).collect()]
        assert boosting.drawn(np.array(keys), tree, 0.5, 42).tolist() == want


def test_saved_forest_scores_the_same(spark, data, tmp_path):
    df = data[2]
    f = boosting.fit_forest(df, COLUMNS, how=Settings(trees=2, depth=3))
    boosting.save(f, spark, str(tmp_path / "m"))
    g = boosting.load(spark, str(tmp_path / "m"))
    score = lambda m: [r.score for r in boosting.add_scores(m, df).orderBy("id").collect()]
    assert score(f) == score(g) and g.columns == tuple(COLUMNS)
    assert sum(r.importance for r in boosting.importances(g, spark).collect()) == pytest.approx(1.0)


def test_odd_tables(spark):
    """No rows, one class alone, columns without values, rows without a label."""
    schema = "a double, b double, Presence int"
    how = Settings(trees=2, depth=2, least_weight=0.0)
    for rows in ([], [(1.0, None, 0)] * 5, [(None, None, 1), (None, None, 0), (2.0, None, None)]):
        df = spark.createDataFrame(rows, schema)
        f = boosting.fit_forest(df, ["a", "b"], how=how)
        assert boosting.add_scores(f, df).count() == len(rows)
    wide = spark.createDataFrame([(float(i), None if i % 3 else 1.0, i % 2) for i in range(50)], schema)
    assert boosting.fit_forest(wide, ["a", "b"], how=how).columns == ("a", "b")


def test_walk_over_bins_ends_where_plain_steps_do():
    """A tree's walk is made of its tables once; it ends where comparing bins one by one does, also in trees that are not finished."""
    r = np.random.default_rng(3)
    forest = boosting.Forest.empty(["a", "b", "c"], 3, 4)
    forest.column[0, :15], forest.column[1, [0, 2]] = r.integers(0, 3, 15), (1, 2)  # full, short, and without a split
    forest.bin[:], forest.missing_left[:] = r.integers(0, 254, forest.bin.shape), r.random(forest.bin.shape) < 0.5
    x = r.integers(0, 256, (500, 3)).astype(np.uint8)
    x[::3, 1] = boosting.MISSING
    assert [forest.steps(t)[2] for t in range(3)] == [4, 2, 0]
    for t in range(3):
        want = []
        for row in x:
            at = 0
            while forest.column[t, at] >= 0:
                v = row[forest.column[t, at]]
                at = 2 * at + 2 - (forest.missing_left[t, at] if v == boosting.MISSING else v <= forest.bin[t, at])
            want.append(at)
        assert forest.places(t, x, True).tolist() == want == forest.places(t, x, True, forest.steps(t)).tolist()


def test_threshold_of_the_chain_comes_from_the_whole_forest(spark, monkeypatch):
    """The query grows as many trees of as many levels as the chain's own defaults, over all rows of the earlier part."""
    from tidewright.plans import habitat, more_queries

    asked = []

    def fit(train, columns, label="Presence", how=Settings(), key=None, edges=None):
        asked.append((how, columns, train.count()))
        return boosting.Forest.empty(columns, 1, 1)

    monkeypatch.setattr(habitat.boosting, "fit_forest", fit)
    monkeypatch.setattr(more_queries, "_features", lambda spark, sf: spark.range(50).selectExpr(
        "id", "timestamp_seconds(id) AS Date", "CAST(id % 2 AS int) AS Presence", *[f"CAST(id AS double) AS {c}" for c in habitat.FEATURE_ORDER]
    ))
    assert more_queries.habitat_threshold(spark, "unused").count() == 1
    how, columns, rows = asked[0]
    assert (how.trees, how.depth) == (500, 6) == (Settings().trees, Settings().depth) and columns == habitat.FEATURE_ORDER and rows == 40
