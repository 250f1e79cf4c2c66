"""Boosted trees with missing values over DataFrames (OP-100 to 103, 105): histograms by level, one aggregation each.

Columns are cut into at most 254 bins at quantiles of a mergeable sketch, taken of all columns in one aggregation. Rows are packed
into blocks of bins and margins, dealt out evenly and written in the shared folder. For each level of a tree one job adds up, for each (node, column, bin), the
first and second derivatives of the logistic loss, of two children for the smaller alone: the other has what is left of their parent. These sums, of the model's size (nodes x columns x 256 at most, whatever the rows), come to the
driver, where running sums over the bins give the gain of each split, with missing values on either side, and the best of each node. Derivatives are added as whole numbers of a fixed unit,
so that a model doesn't depend on how rows are dealt out. Rows and columns are drawn once a tree, rows by a hash of the row. Blocks are written anew every few trees,
with their margins and the draws of the trees to come, and the former ones deleted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import discard, scratch, stage
from .sampling import uniform_array

MISSING = 255
#: Rows of a block, whose arrays stay in a core's cache; rows of a task, at most; bytes of sums that tasks send to the driver at once, beyond which they are added up in an exchange.
BLOCK, ROWS_A_TASK, MOST_SENT = 16_384, 1 << 24, 64 << 20
NODES = "tree int, node int, feature string, threshold double, missing_left boolean, value double, gain double, cover double"


@dataclass(frozen=True)
class Settings:
    """How trees are grown; the names of the penalties are those of the usual objective."""

    trees: int = 500
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    least_weight: float = 5.0
    split_penalty: float = 0.1
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 254
    seed: int = 42
    write_every: int = 10


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of (tree, place); the children of place i are 2i + 1 and 2i + 2; a leaf has column -1."""

    columns: tuple[str, ...]
    column: np.ndarray
    threshold: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(columns: list[str], trees: int, depth: int) -> Forest:
        shape = (trees, 2 ** (depth + 1) - 1)
        zeros = np.zeros(shape)
        return Forest(
            tuple(columns), np.full(shape, -1, np.int32), zeros.copy(), np.zeros(shape, np.int32), np.zeros(shape, bool), zeros.copy(), zeros.copy(), zeros.copy()
        )

    @property
    def depth(self) -> int:
        return int(math.log2(self.column.shape[1] + 1)) - 1

    def part(self, first: int, last: int) -> Forest:
        return replace(self, **{k: getattr(self, k)[first:last] for k in ("column", "threshold", "bin", "missing_left", "value", "gain", "cover")})

    def steps(self, t: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Tree t over bins: the column of each place, the place that each of its bins goes on to, a leaf's its own, and the levels that have splits."""
        here = np.arange(self.column.shape[1])[:, None]
        v, leaf = np.arange(256)[None], self.column[t][:, None] < 0
        left = np.where(v == MISSING, self.missing_left[t][:, None], v <= self.bin[t][:, None])
        split = np.flatnonzero(self.column[t] >= 0)
        levels = int(split.max() + 1).bit_length() if len(split) else 0
        return np.maximum(self.column[t], 0).astype(np.int64), np.where(leaf, here, 2 * here + 2 - left).ravel(), levels

    def places(self, t: int, x: np.ndarray, binned: bool = False, steps: tuple[np.ndarray, np.ndarray, int] | None = None) -> np.ndarray:
        """Where each row of ``x`` ends in tree t, the tree being finished or not; ``steps`` are those of t, where they are at hand."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        if binned:
            return _walk(steps or self.steps(t), np.ascontiguousarray(x.T), rows)
        for _ in range(self.depth):
            c = self.column[t, at]
            v = x[rows, np.maximum(c, 0)]
            left = np.where(np.isnan(v), self.missing_left[t, at], v <= self.threshold[t, at])
            at = np.where(c < 0, at, 2 * at + 2 - left)
        return at

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in range(len(self.column)):
            out += self.value[t].take(self.places(t, x))
        return out

    def cuts(self) -> list[np.ndarray] | None:
        """The thresholds of each column, ascending; None where one has too many for bins of a byte."""
        out = [np.unique(self.threshold[(self.column == c) & np.isfinite(self.threshold)]) for c in range(len(self.columns))]
        return out if max(map(len, out), default=0) < MISSING else None

    def over(self, cuts: list[np.ndarray]) -> Forest:
        """The same trees over the bins that ``cuts`` make: a value's bin is the number of cuts below it."""
        bins = np.zeros_like(self.bin)
        for c, e in enumerate(cuts):
            mine = self.column == c
            bins[mine] = np.searchsorted(e, self.threshold[mine])
        return replace(self, bin=bins)


def _walk(steps: tuple[np.ndarray, np.ndarray, int], x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where ``rows`` of a block end in a tree of such ``Forest.steps``; ``x`` has the block's bins by column."""
    column, after, levels = steps
    if not levels:
        return np.zeros(len(rows), np.int64)
    at = after.take(x[column[0]].take(rows))
    flat, first = x.ravel(), column * x.shape[1]
    for _ in range(levels - 1):
        place = first.take(at)
        place += rows
        at <<= 8
        at += flat.take(place)
        at = after.take(at)
    return at


def _add_margins(m: np.ndarray, trees: list[tuple], x: np.ndarray, rows: np.ndarray) -> None:
    """Adds what each of the trees, (steps, values), gives to ``rows``, one tree after another."""
    for steps, value in trees:
        m += value.take(_walk(steps, x, rows))


def _trees(forest: Forest) -> list[tuple]:
    return [(forest.steps(t), forest.value[t]) for t in range(len(forest.column))]


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of edges below each value; the last bin is ``len(edges)``, NaN is ``MISSING``."""
    return np.where(np.isnan(x), MISSING, np.searchsorted(edges, x)).astype(np.uint8)


def cut_points(df: DataFrame, columns: list[str], bins: int = 254, accuracy: int = 10_000) -> list[np.ndarray]:
    """Bin edges of each column, ascending: quantiles of a mergeable sketch over all rows, one aggregation for all columns."""
    at = F.array(*[F.lit(float(x)) for x in np.linspace(0, 1, bins)])  # from the least value to the largest
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), at, F.lit(accuracy)).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [0.0], float)) for c in columns]


def _blocks(batches, rows: int):
    """Batches as tables of ``rows`` rows, the last one shorter."""
    waiting, n = [], 0
    for b in batches:
        waiting.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(waiting)
        for at in range(0, n - n % rows, rows):
            yield t.slice(at, rows)
        waiting, n = t.slice(n - n % rows).to_batches(), n % rows
    if n:
        yield pa.Table.from_batches(waiting)


def drawn(key: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree takes: ``sampling.uniform`` of the key and the tree."""
    return np.ones(len(key), bool) if share >= 1 else uniform_array(key, tree, seed) < share


def _draws(key: np.ndarray, trees: range, how: Settings) -> bytes:
    """A bit for each tree and row: whether the tree takes the row."""
    return b"".join(np.packbits(drawn(key, t, how.row_share, how.seed)).tobytes() for t in trees)


def _pack(columns: list[str], edges: list[np.ndarray], trees: range, how: Settings):
    """A row of packed bins, by column, labels, keys, margins and draws for each block."""

    def run(batches):
        for b in _blocks(batches, BLOCK):
            bins = np.empty((len(columns), b.num_rows), np.uint8)
            for i, e in enumerate(edges):
                bins[i] = _bins(b.column(i).to_numpy().astype(float), e[:-1])
            label, key = (b.column(len(columns) + i).to_numpy() for i in (0, 1))
            packed = [bins.tobytes(), label.astype(np.uint8).tobytes(), key.astype("<i8").tobytes(), np.zeros(b.num_rows).tobytes(), _draws(key, trees, how)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["bins", "label", "key", "margin", "drawn"])

    return run


_BLOCKS = "bins binary, label binary, key binary, margin binary, drawn binary"


def _unpack(batches, n_columns: int, *more: tuple[str, str]):
    """Of each block the bins by column, the labels, the margins, and ``more`` columns as arrays of a type."""
    kinds = [("label", "u1"), ("margin", "f8"), *more]
    for b in batches:
        at = [(b.schema.get_field_index(n), kind) for n, kind in kinds]
        for r in range(b.num_rows):
            yield np.frombuffer(b.column("bins")[r].as_buffer(), np.uint8).reshape(n_columns, -1), *[np.frombuffer(b.column(i)[r].as_buffer(), kind) for i, kind in at]


def _later(recent: Forest, n_columns: int, trees: range, how: Settings):
    """Blocks with the margins that the recent trees add, and with the draws of the trees to come."""

    def run(batches):
        added = _trees(recent)
        for x, y, m, key in _unpack(batches, n_columns, ("key", "<i8")):
            m = m.copy()
            _add_margins(m, added, x, np.arange(len(m)))
            packed = [x.tobytes(), y.tobytes(), key.tobytes(), m.tobytes(), _draws(key, trees, how)]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in packed], names=["bins", "label", "key", "margin", "drawn"])

    return run


def _histograms(recent: Forest, growing: Forest, nth: int, level: int, nodes: list[int], use: list[int], weight: float, unit: float, n_columns: int):
    """Sums of derivatives by (node, column, bin) of a task's blocks for some nodes of a level, in whole units. ``nth``: the tree's number since its draws were written."""
    slot = np.full(2 ** (level + 1) - 1, -1, np.int64)
    slot[nodes] = np.arange(len(nodes))

    def run(batches):
        total, size = np.zeros((2, len(use), len(nodes) * 256), np.int64), len(nodes) * 256
        added, grown = _trees(recent), growing.steps(0)
        for x, y, m, bits in _unpack(batches, n_columns, ("drawn", "u1")):
            n = len(y)
            rows = np.flatnonzero(np.unpackbits(bits.reshape(-1, -(-n // 8))[nth], count=n))
            cell = np.zeros(len(rows), np.int64)
            if level:
                cell = slot.take(_walk(grown, x, rows))
                here = np.flatnonzero(cell >= 0)
                rows, cell = rows.take(here), cell.take(here)
                cell <<= 8
            m = m.take(rows)
            _add_margins(m, added, x, rows)
            p = 1 / (1 + np.exp(-m))
            y = y.take(rows)
            w = np.where(y == 1, weight, 1.0)
            sums = [np.rint(w * (p - y) / unit), np.rint(w * p * (1 - p) / unit)]
            for i, c in enumerate(use):
                at = cell + x[c].take(rows)
                for k, s in enumerate(sums):
                    total[k, i] += np.bincount(at, s, size).astype(np.int64)
        i, at = np.nonzero(total[0] | total[1])
        if len(i):
            node, c = np.array(nodes, np.int32)[at >> 8], np.array(use, np.int32)[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(c), pa.array((at & 255).astype(np.int32)), pa.array(total[0, i, at]), pa.array(total[1, i, at])], names=["node", "column", "bin", "g", "h"]
            )

    return run


def _sums(blocks: DataFrame, tasks: int, run, nodes: list[int], use: list[int]) -> np.ndarray:
    """What ``run`` adds up over all blocks, by (g or h, node, column, bin). Few tasks send their sums to the driver, those of many are added up in an exchange before."""
    parts = blocks.mapInArrow(run, "node int, column int, bin int, g long, h long")
    if tasks * len(nodes) * len(use) * 256 * 28 > MOST_SENT:
        parts = parts.groupBy("node", "column", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    node, column, bin_, g, h = (c.to_numpy() for c in parts.toArrow().columns)
    out = np.zeros((2, len(nodes), len(use), 256), np.int64)
    at = np.searchsorted(nodes, node), np.searchsorted(use, column), bin_
    for k, v in enumerate((g, h)):
        np.add.at(out[k], at, v)
    return out


def best_splits(sums: np.ndarray, unit: float, how: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best split of each (node, column): its gain (-inf where none is allowed), bin, side of missing values, and the left child's sums.

    ``sums``: whole units by (g or h, node, column, bin), bin 255 for missing values. Of equal gains the least bin is taken, and missing values go right.
    """
    gone, total = sums[..., MISSING], sums.sum(-1)
    below = np.cumsum(sums[..., :MISSING], -1)
    left = np.stack([below, below + gone[..., None]], -1) * unit  # by (g or h, node, column, bin, side)
    whole = total[..., None, None] * unit
    score = lambda g, h: np.maximum(np.abs(g) - how.l1, 0.0) ** 2 / np.maximum(h + how.l2, 1e-300)
    gain = score(left[0], left[1]) + score(whole[0] - left[0], whole[1] - left[1]) - score(whole[0], whole[1])
    some = below[1][..., None] > 0  # a left side has values, not missing ones alone: that split is the one after the last bin
    allowed = some & (left[1] >= how.least_weight) & (whole[1] - left[1] >= how.least_weight) & (gain > max(how.split_penalty, 1e-6))
    flat = np.where(allowed, gain, -np.inf).reshape(*gain.shape[:2], -1)
    best = flat.argmax(-1)
    take = lambda x: np.take_along_axis(x.reshape(*gain.shape[:2], -1), best[..., None], -1)[..., 0]
    return take(flat), best // 2, best % 2 == 1, np.stack([take(left[0]), take(left[1])])


def _leaf(g: float, h: float, how: Settings) -> float:
    return -how.step * math.copysign(max(abs(g) - how.l1, 0.0), g) / (h + how.l2)


def _dealt(rows: int, cores: int, how: Settings) -> tuple[int, int]:
    """After how many trees blocks are written anew, and the tasks of each level's job.

    A job has a task a core, or fewer where there are fewer blocks, and more only where a task would have more than ``ROWS_A_TASK`` rows: each level waits for its tasks to start. Trees that
    aren't in the margins yet are walked again for each level, which costs more than writing once a core has many rows. The forest doesn't depend on either.
    """
    rounds = -(-rows // (cores * ROWS_A_TASK))
    tasks = cores * rounds if rounds > 1 else max(1, min(cores, -(-rows // BLOCK)))
    return max(1, min(how.write_every, max(2, round(math.sqrt(5e6 * tasks / max(1, rows)))))), tasks


def fit_forest(
    train: DataFrame, columns: list[str], label: str = "Presence", how: Settings = Settings(), key: Column | None = None, edges: list[np.ndarray] | None = None
) -> Forest:
    """OP-100, 101, 102: trees of the logistic loss; positives weigh as much as the classes' ratio (4 without positives).

    Missing (NULL or NaN) goes to the side that gains more, learned at each split. ``key``, a long, draws the rows; by default a hash of the row,
    so that equal rows are drawn together. Rows without a label are left out. A column without values never splits.
    """
    spark = train.sparkSession
    rows = train.where(F.col(label).isNotNull()).select(
        *[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("int").alias("_label"),
        (F.xxhash64(*columns, label) if key is None else key.cast("long")).alias("_key")
    )
    n = rows.agg(F.count_if(F.col("_label") == 1), F.count_if(F.col("_label") != 1)).first()
    weight = n[1] / n[0] if n[0] else 4.0
    edges = cut_points(rows, columns, how.bins) if edges is None else edges
    every, tasks = _dealt(n[0] + n[1], spark.sparkContext.defaultParallelism, how)
    packed = rows.mapInArrow(_pack(columns, edges, range(every), how), _BLOCKS)
    path = scratch(spark, "blocks")
    blocks = stage(packed.repartition(tasks), path).coalesce(tasks)
    # whole units: sums over all rows stay below 2^62, and those of a block are exact in doubles
    heavy = max(weight, 1.0)
    unit = 2.0 ** -max(0, min(32, 61 - math.ceil(math.log2(max(2.0, (n[0] + n[1]) * heavy))), 52 - math.ceil(math.log2(BLOCK * heavy))))
    forest = Forest.empty(columns, how.trees, how.depth)
    written = 0
    for t in range(how.trees):
        if t and t % every == 0:
            now = scratch(spark, "blocks")
            blocks = stage(blocks.mapInArrow(_later(forest.part(written, t), len(columns), range(t, t + every), how), _BLOCKS), now).coalesce(tasks)
            discard(spark, path)
            written, path = t, now
        draw = np.random.default_rng([how.seed, t])
        use = sorted(int(c) for c in draw.permutation(len(columns))[: max(1, int(how.column_share * len(columns)))])
        sums: dict[int, tuple[float, float]] = {}
        above: dict[int, np.ndarray] = {}
        counted = [0]
        for level in range(how.depth):
            run = _histograms(forest.part(written, t), forest.part(t, t + 1), t - written, level, counted, use, weight, unit, len(columns))
            first, dense = 2**level - 1, np.zeros((2, 2**level, len(use), 256), np.int64)
            dense[:, np.array(counted) - first] = _sums(blocks.select("bins", "label", "margin", "drawn"), tasks, run, counted, use)
            for place in counted if level else []:  # a brother has what is left of their parent
                dense[:, (place - 1 ^ 1) + 1 - first] = above[(place - 1) // 2] - dense[:, place - first]
            gain, at, missing_left, left = best_splits(dense, unit, how)
            if not level and dense.any():
                sums[0] = tuple(float(x) for x in dense[:, 0, 0].sum(-1) * unit)
            above, counted = {}, []
            for k in np.flatnonzero(gain.max(-1) > -np.inf):
                i, place, c = int(gain[k].argmax()), int(k) + first, use[int(gain[k].argmax())]  # the first column of equals
                forest.column[t, place], forest.bin[t, place], forest.missing_left[t, place] = c, at[k, i], missing_left[k, i]
                # where all values go left, only missing ones go right
                forest.threshold[t, place] = edges[c][at[k, i]] if at[k, i] < len(edges[c]) - 1 else math.inf
                forest.gain[t, place] = gain[k, i]
                (lg, lh), (g, h) = left[:, k, i], dense[:, k, i].sum(-1) * unit
                sums[2 * place + 1], sums[2 * place + 2] = (lg, lh), (g - lg, h - lh)
                above[place] = dense[:, k]
                counted.append(2 * place + 1 if 2 * lh <= h else 2 * place + 2)
            if not counted:
                break
        for node, (g, h) in sums.items():
            forest.cover[t, node] = h
            if forest.column[t, node] < 0:
                forest.value[t, node] = _leaf(g, h, how)
    discard(spark, path)
    return forest


def add_scores(forest: Forest, df: DataFrame, out: str = "score") -> DataFrame:
    """OP-103: ``df`` with the probability of the positive class, whole batches at a time; works on streams too."""
    columns = list(forest.columns)
    kept = [c for c in df.columns if c != out]
    at = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.DoubleType())])
    inner = df.select(*kept, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    cuts = forest.cuts()

    def run(batches):
        trees = _trees(forest.over(cuts)) if cuts is not None else None
        for b in batches:
            x = b.column(len(kept))
            rows = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(columns))
            if trees is None:
                m = forest.margins(rows)
            else:  # the trees' own thresholds as bins, so that a row is compared once with each
                m = np.zeros(len(rows))
                _add_margins(m, trees, np.stack([_bins(rows[:, c], e) for c, e in enumerate(cuts)]), np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-m)))], names=[*kept, out])

    return inner.mapInArrow(run, at)


def nodes(forest: Forest, spark: SparkSession) -> DataFrame:
    """The splits and leaves as a table (NODES); a leaf has no feature, a threshold of NULL sends missing values alone to the right."""
    rows = []
    for t in range(len(forest.column)):
        reached = [0]
        for i in reached:
            c = int(forest.column[t, i])
            if c >= 0:
                reached += [2 * i + 1, 2 * i + 2]
            at = float(forest.threshold[t, i])
            rows.append((
                t, i, forest.columns[c] if c >= 0 else None, at if c >= 0 and math.isfinite(at) else None, bool(forest.missing_left[t, i]) if c >= 0 else None,
                float(forest.value[t, i]) if c < 0 else None, float(forest.gain[t, i]) if c >= 0 else None, float(forest.cover[t, i])
            ))
    return spark.createDataFrame(rows, NODES)


def save(forest: Forest, spark: SparkSession, path: str) -> None:
    """OP-11: the table of nodes, and the columns in their order, as Parquet."""
    about = spark.createDataFrame([(list(forest.columns), len(forest.column), forest.depth)], "columns array<string>, trees int, depth int")
    nodes(forest, spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Forest:
    """OP-11: a forest that ``save`` has written; bins aren't kept, as only training needs them."""
    about = spark.read.parquet(f"{path}/about").first()
    forest = Forest.empty(list(about["columns"]), about["trees"], about["depth"])
    for r in spark.read.parquet(f"{path}/nodes").collect():
        at = r["tree"], r["node"]
        forest.cover[at] = r["cover"]
        if r["feature"] is None:
            forest.value[at] = r["value"]
            continue
        forest.column[at], forest.missing_left[at], forest.gain[at] = forest.columns.index(r["feature"]), r["missing_left"], r["gain"]
        forest.threshold[at] = math.inf if r["threshold"] is None else r["threshold"]
    return forest


def importances(forest: Forest, spark: SparkSession) -> DataFrame:
    """OP-105: the mean gain of each column's splits as a share of all columns' means, the largest first."""
    split = forest.column >= 0
    mean = [float(forest.gain[split & (forest.column == i)].mean()) if (split & (forest.column == i)).any() else 0.0 for i in range(len(forest.columns))]
    rows = [(c, m / (sum(mean) or 1.0)) for c, m in zip(forest.columns, mean, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
