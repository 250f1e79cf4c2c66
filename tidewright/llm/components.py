"""Connected components of a graph given by its edges, distributed: union-find within partitions, then stars.

Each partition's edges are first contracted to trees by union-find; large-star and small-star rounds
then join these until nothing changes. Minima are aggregated before they are joined back, and both sides of each join are exchanged, so that a
node with very many neighbours is split rather than gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


class UnionFind(dict):
    """Node -> parent; the smallest node of a set is its root."""

    def root(self, x):
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while (up := self.get(x, x)) != top and up != x:  # shorten the path
            self[x] = top
            x = up
        return top

    def union(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _contract(batches):
    found = UnionFind()
    out = lambda: [
        pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([found.root(x) for x in list(found)], pa.int64())], names=["a", "b"])
    ]
    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            found.union(x, y)
        if len(found) > 1_000_000:  # what is found so far goes on; stars join the rest
            yield from out()
            found.clear()
    if found:
        yield from out()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or not larger) neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    ) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long); a component is named by its smallest node."""
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    now, before = materialize(clean.mapInArrow(_contract, "a long, b long").where("a != b").distinct(), "edges"), None
    sign = lambda e: tuple(
        e.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
    )
    for _ in range(rounds):
        now = materialize(_star(now, large=True), "edges")
        now = materialize(_star(now, large=False), "edges")
        seen = sign(now)
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
