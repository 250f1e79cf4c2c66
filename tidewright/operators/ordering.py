"""Order without a global sort in one task: ranges of a key, their carried totals, exact order statistics by radix selection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.tables import scratch, stage

#: Rows of a range: tables of no more are one range.
ROWS = 1_000_000
#: The most ranges that one sketch cuts; beyond ROWS times as many rows, ranges grow.
MOST_RANGES = 4096
_STEP = 64
#: How the 64 bits of a key are split for selection: two or three rounds of counts, mostly one or two.
RADIX = (24, 20, 20)


def _comparable(df: DataFrame, key: str) -> Column:
    """A number in the key's order; NULL stays NULL."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(key).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(key)
    return F.col(key)


def splitters(sketch: list | None, n: int, rows: int | None = None) -> list:
    """Edges between ranges of about ``rows`` rows, from the quantiles of a sketch of n rows; none where one range holds all."""
    wanted = min(MOST_RANGES, -(-n // (rows or ROWS)))
    if wanted < 2 or not sketch:
        return []
    at = [sketch[round(i * (len(sketch) - 1) / wanted)] for i in range(1, wanted)]
    return sorted(set(at))


def in_ranges(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``df``, written, with ``_block``, the number of the range that its key falls into, and the number of ranges.

    The number of ranges follows from the rows, whatever the session's partitions. Edges come from a mergeable sketch that is taken while
    the table is written, so that a range has about ``ROWS`` rows, more only where one key has more. NULL keys are in the first range.
    """
    seen = Observation()
    at = F.expr(f"array({', '.join(f'{i / MOST_RANGES!r}D' for i in range(MOST_RANGES + 1))})")  # parsed at once
    sketch = F.percentile_approx(_comparable(df, key), at, F.lit(10 * MOST_RANGES))
    held = stage(df.observe(seen, F.count("*").alias("n"), sketch.alias("at")), scratch(df.sparkSession, "ordered"))
    edges = splitters(seen.get["at"], seen.get["n"] or 0)
    if not edges:
        return held.withColumn("_block", F.lit(0)), 1
    x = _comparable(held, key)
    # the number of edges at or below x, by two short searches
    every = F.array(*[F.lit(e) for e in edges])
    coarse = F.array(*[F.lit(e) for e in edges[_STEP - 1 :: _STEP]]) if len(edges) >= _STEP else F.array().cast(f"array<{_sql_type(edges[0])}>")
    count = lambda a: F.size(F.filter(a, lambda e: e <= x))
    block = F.when(x.isNull(), 0).otherwise(count(coarse) * _STEP + count(F.slice(every, count(coarse) * _STEP + 1, F.lit(_STEP))))
    return held.withColumn("_block", block.cast("int")), len(edges) + 1


def _sql_type(x) -> str:
    return "double" if isinstance(x, float) else "bigint"


def running(df: DataFrame, key: str, sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Running totals of ``sums`` (column to output) over rows with distinct ``key`` (in each group), from the least key, each row's own included.

    Totals run within a range; the totals of the ranges before, a row for each range and group, are added.
    """
    cut, ranges = in_ranges(df, key)
    inside = W.partitionBy(*by, "_block").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    if ranges == 1:
        return cut.withColumns({out: F.sum(c).over(inside) for c, out in sums.items()}).drop("_block")
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    renamed = offsets.withColumnsRenamed({k: f"_g_{k}" for k in (*by, "_block")})
    same = F.lit(True)
    for k in (*by, "_block"):
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    met = cut.join(renamed, same).drop(*[f"_g_{k}" for k in (*by, "_block")])
    return met.withColumns({out: F.sum(c).over(inside) + F.col(f"_o_{c}") for c, out in sums.items()}).drop("_block", *[f"_o_{c}" for c in sums])


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the doubles; both zeros have one key."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))


def from_bits(k: int) -> float:
    b = k & ((1 << 63) - 1) if k >> 63 else ~k & ((1 << 64) - 1)
    return float(np.array([b], np.uint64).view(float)[0])


def _counts(n_columns: int, used: int, width: int, wanted: list[np.ndarray] | None):
    """Rows, least and largest key of each bin of ``width`` bits after the first ``used`` ones, of keys whose first bits are ``wanted``."""
    shift = np.uint64(64 - used - width)

    def bins(i: int, keys: list[np.ndarray]):
        k = np.sort(np.concatenate(keys))
        p = k >> shift
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[starts[1:], len(p)]
        return np.full(len(starts), i, np.int32), p[starts].view(np.int64), ends - starts, k[starts].view(np.int64), k[ends - 1].view(np.int64)

    def run(batches):
        for b in batches:
            out = []
            for i in range(n_columns):
                x = b.column(i).to_numpy(zero_copy_only=False).astype(float)
                k = ordered_bits(x[~np.isnan(x)])
                if wanted is not None:
                    k = k[np.isin(k >> np.uint64(64 - used), wanted[i])]
                if len(k):
                    out.append(bins(i, [k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["i", "bin", "n", "least", "most"])

    return run


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """variable, and ``at`` (array<double>): the exact quantiles of each column that has values, interpolated between neighbours.

    Radix selection over order-preserving 64-bit keys: rows are counted by the leading bits for all columns and ranks at once, then, by
    the next bits, those alone whose leading bits a wanted rank falls into, until a bin holds one value. At most three
    aggregations, mostly one or two; nothing is sorted as a whole or written, and the driver gets a row for each column and rank. NaN counts as missing.
    """
    spark = df.sparkSession
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found: list[dict[int, float]] = [{} for _ in columns]  # values by rank
    open_: dict[tuple[int, int], dict[int, int]] = {}  # ranks, by column and leading bits, less the rows before these
    totals = [0] * len(columns)
    used = 0
    for width in RADIX:
        wanted = None if not used else [np.array(sorted(p for c, p in open_ if c == i), np.uint64) for i in range(len(columns))]
        counted = plain.mapInArrow(_counts(len(columns), used, width, wanted), "i int, bin long, n long, least long, most long")
        # keys are unsigned, but those of a bin share their leading bit, so that signed order is theirs
        bins = counted.groupBy("i", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("a"), (F.min("least") == F.max("most")).alias("one"))
        head = F.shiftrightunsigned("bin", width) if used else F.lit(0).cast("long")
        group = W.partitionBy("i", "head")
        upto = bins.withColumn("head", head).withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
        if used:
            rows = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("i", i), ("head", p), ("rank", rank), ("rest", rest))]) for (i, p), ranks in open_.items() for rank, rest in ranks.items()])
            wanted_here = F.filter(rows, lambda w: (w["i"] == F.col("i")) & (w["head"] == F.col("head")))
        else:
            ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("all") - 1) * p), F.ceil((F.col("all") - 1) * p)) for p in map(F.lit, shares)])))
            wanted_here = F.transform(ranks, lambda r: F.struct(F.col("i").cast("long").alias("i"), F.col("head"), r.alias("rank"), r.alias("rest")))
        mine = F.filter(wanted_here, lambda w: (w["rest"] >= F.col("upto") - F.col("n")) & (w["rest"] < F.col("upto")))
        rows = upto.select("i", "bin", "n", "upto", "all", "one", "a", F.explode(mine).alias("w")).select("i", "bin", "all", "one", "a", "w.rank", (F.col("w.rest") - F.col("upto") + F.col("n")).alias("rest")).collect()
        if not used:
            for r in rows:
                totals[r["i"]] = r["all"]
        used += width
        open_ = {}
        for r in rows:
            if r["one"] or used == 64:
                found[r["i"]][r["rank"]] = from_bits(r["a"] % (1 << 64))
            else:
                open_.setdefault((r["i"], r["bin"] % (1 << 64)), {})[r["rank"]] = r["rest"]
        if not open_:
            break

    def value(i: int, share: float) -> float:
        rank = (totals[i] - 1) * share
        low, high = found[i][math.floor(rank)], found[i][math.ceil(rank)]
        return low if low == high else low + (high - low) * (rank - math.floor(rank))

    rows = [(c, [value(i, p) for p in shares]) for i, c in enumerate(columns) if totals[i]]
    return spark.createDataFrame(rows, "variable string, at array<double>")


def around(marks: DataFrame, x: str, mark: str) -> DataFrame:
    """``marks`` (distinct ``x``) with ``below`` and ``above``: the nearest non-null ``mark`` at or before and at or after x."""
    cut, ranges = in_ranges(marks, x)
    up, down = W.partitionBy("_block").orderBy(x).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("_block").orderBy(F.desc(x)).rowsBetween(W.unboundedPreceding, 0)
    below, above = F.max(mark).over(up), F.min(mark).over(down)
    if ranges == 1:
        return cut.withColumns({"below": below, "above": above}).drop("_block")
    ends = cut.groupBy("_block").agg(F.min(mark).alias("_least"), F.max(mark).alias("_most"))
    before, after = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_block", F.max("_most").over(before).alias("_before"), F.min("_least").over(after).alias("_after"))  # a row for each range
    met = cut.join(F.broadcast(carried), "_block")  # at most MOST_RANGES rows
    return met.withColumns({"below": F.coalesce(below, "_before"), "above": F.coalesce(above, "_after")}).drop("_block", "_before", "_after")
