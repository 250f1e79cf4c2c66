import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SF
from tests.oracle import assert_same, connect
from tidewright.llm import components, near_dedup, queries

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=4, percent=80):
    """(doc_id -> component) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    has = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            has[x].append(k)
    join = components.UnionFind()
    for pair in {(a, b) for v in has.values() for n, a in enumerate(v) for b in v[n + 1 :]}:
        (i, x), (j, y) = sets[pair[0]], sets[pair[1]]
        if i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
            join.union(i, j)
    return {i: join.root(i) for i, _ in sets if i is not None}, {i: len(s) for i, s in sets}


def check(df, **how):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    comp, n = brute(rows, how.get("width", 4))
    got = near_dedup.near_groups(df, **how).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (comp[r.doc_id], comp[r.doc_id] == r.doc_id), r
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingles(t, how.get("width", 4)))) for i, t in rows)


def test_equals_brute_force(docs):
    check(docs)
    check(docs, width=5)


def test_equals_sql(spark):
    assert_same(queries.op4_near_dedup(spark, SF), connect(SF), queries.ORACLES["op4_near_dedup"])


def test_odd_rows(odd, none):
    check(odd)
    assert near_dedup.near_groups(none).count() == 0 == near_dedup.drop_near_duplicates(none).count()
    comp, _ = brute([(r.doc_id, r.text) for r in odd.collect()])
    kept = near_dedup.drop_near_duplicates(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(comp.values()))
    assert sum(r.doc_id is None for r in kept) == odd.where("doc_id IS NULL").count()


@pytest.mark.parametrize("how", [{}, {"block": 8}, {"block_shingles": 700}])
def test_group_around_the_threshold(spark, how):
    """Copies with few edits, many of them beyond 0.8 of each other; blocks small enough, in members or in shingles, to split the bucket."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    comp, _ = brute(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(df, **how).collect()} == comp


@pytest.mark.parametrize("block", [16, 1024])
def test_buckets_of_unlike_sizes(spark, block):
    """Beginnings of one text share buckets whatever their lengths: only those of near lengths are links, and members that no centre may be linked with still meet each other."""
    lengths = [*range(20, 26), *range(60, 72, 2), 110, 139, 173, *range(900, 1000, 9), 1125, 1500, 1500]
    words = [f"w{k}" for k in range(1600)]
    random.Random(3).shuffle(words)
    rows = [(k, " ".join(words[:n])) for k, n in enumerate(lengths)] + [(100 + k, " ".join(words[-n:])) for k, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, bands=12, rows=1, block=block)
    assert len({r.component_id for r in near_dedup.near_groups(df, bands=12, rows=1, block=block).collect()}) > 6


def test_drop(docs, clashing):
    kept = near_dedup.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    comp, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(comp.values()))


def test_intersections():
    r = np.random.default_rng(1)
    left, right = ([np.unique(r.integers(0, 300, r.integers(0, 90))) for _ in range(n)] for n in (30, 25))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert near_dedup.intersections(left, right).tolist() == want
    assert near_dedup.intersections(left, left).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in left] for a in left]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    for shared, size in ((400, 500), (80, 100), (9, 10)):
        same = []
        for _ in range(40):
            x = r.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            a, b = x[:size], np.concatenate([x[:shared], x[size:]])
            s = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 128)
            assert np.isfinite(s).all() and len({int(v) for v in s[0]} - set(range(128))) == 0
            same.append((s[0] == s[1]).mean())
        assert np.mean(same) == pytest.approx(shared / (2 * size - shared), abs=0.03)


def test_components(spark):
    r = random.Random(5)
    edges = [
        (r.randrange(400), r.randrange(400)) for _ in range(300)
    ] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2300)]
    join = components.UnionFind()
    for a, b in edges:
        join.union(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {x.node: x.component for x in got} == {
        x: join.root(x) for e in edges for x in e if e[0] != e[1] or join.root(x) in {join.root(y) for f in edges if f[0] != f[1] for y in f}
    }
    assert len(got) == len({x.node for x in got})
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
