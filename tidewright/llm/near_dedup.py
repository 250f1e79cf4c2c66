"""Near-duplicate documents by SuperMinHash, banding, verification on full sets, and union-find.

A document's set holds its distinct shingles of ``width`` lower-cased (A-Z) words; with fewer words the
whole sequence is the only one; without words the set is empty and links to nothing. Documents are linked
where 100 * intersection >= ``percent`` * union.

1. Each text is read once for its set's digest, its SuperMinHash signature and the keys of its bands.
2. Equal sets are merged under their smallest doc_id; only these representatives go on.
3. In each bucket of a band, the member with most copies is the centre. The pairs of a centre and a
   member whose sizes allow a link are verified on full sets, and components are found from the links.
4. A bucket of three or more whose members still lie in several components is compared whole, in blocks of
   members and within a task, exactly; only links that join components are emitted. No pairs are
   emitted within a group, and no bucket is capped.

With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability 5e-8.

Rows of one doc_id count as one document; rows with a null doc_id are linked with nothing and kept. Null texts have empty
sets. Each input row gives one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, chunks, give_back, materialize, mix64, pieces, word_hashes
from .components import UnionFind, connected_components

BANDS, ROWS = 32, 4
WIDTH, PERCENT = 4, 80
BLOCK = 1024
#: Shingles of a block of members that are compared whole, 8 bytes each.
BLOCK_SHINGLES = 2 << 20
CHUNK_BYTES = 1 << 20
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.lower().split()  # bytes.lower() folds A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        rolled = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            rolled = rolled * _ROLL + h[k : len(h) - n + 1 + k]
        return np.unique(mix64(rolled + np.uint64(n)))


def superminhash(elements: np.ndarray, owner: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (docs x m) of sets given as elements with their owners.

    Each element permutes the m registers step by step; at step j it offers j plus a uniform number to the
    register that its permutation has there. The steps run over all elements at once, and a set stops
    once all its registers are below the step.
    """
    out = np.full((docs, m), np.inf)
    every = np.arange(m, dtype=np.uint8 if m <= 256 else np.int32)
    perm = None
    for j in range(m):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            r = mix64(elements + np.uint64(2 * j + 1) * _ROLL)
        k = j + (mix64(r ^ np.uint64(0xA5A5A5A5)) % np.uint64(m - j)).astype(np.int64)
        at = np.arange(len(elements))
        register = k if perm is None else perm[at, k].astype(np.int64)
        np.minimum.at(out, (owner, register), j + (r >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        on = (out.max(axis=1) > j + 1)[owner]
        if not on.any():
            break
        if perm is None:
            perm = np.tile(every, (int(on.sum()), 1))
        else:
            perm = perm[on]
        k, at = k[on], at[: len(perm)]
        perm[at, k] = perm[at, j]  # what stood at j; the place j itself isn't read again
        elements, owner = elements[on], owner[on]
    return out


def _sketch(bands: int, rows: int, width: int):
    def run(batches):
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for b in pieces(batches):
            texts = byte_column(b)
            sizes, digests, keys = [], [], []
            for lo, hi in chunks([len(t) for t in texts], CHUNK_BYTES):
                sets = [shingle_set(t, width) for t in texts[lo:hi]]
                n = np.array([len(s) for s in sets])
                sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets), bands * rows)
                part = mix64(sig.view(np.uint64)).reshape(len(sets), bands, rows)
                key = np.repeat(salt[None, :], len(sets), 0)
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        key = mix64(key * _ROLL + part[:, :, k])
                sizes += n.tolist()
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys.append(key.view(np.int64))
            flat = np.concatenate(keys).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists],
                names=["doc_id", "n_shingles", "digest", "keys"]
            )

    return run


def _sets(width: int):
    def run(batches):
        for b in pieces(batches):
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([shingle_set(t, width).view(np.int64) for t in byte_column(part)], pa.list_(pa.int64()))],
                    names=["id", "shingles"]
                )

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets: shingles in many sets by a matrix product, others pair by pair."""
    elements = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    _, column, count = np.unique(elements, return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    often = count > 12
    rank = np.cumsum(often) - 1
    hits = often[column]
    c, o = rank[column[hits]], owner[hits]
    for a in range(0, int(often.sum()), 4096):
        inside = (c >= a) & (c < a + 4096)
        m = np.zeros((len(left) + len(right), min(4096, int(often.sum()) - a)), np.float32)
        m[o[inside], c[inside] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    few = (count[column] > 1) & ~hits
    order = np.argsort(column[few], kind="stable")
    c, o = column[few][order], owner[few][order]
    for step in range(1, 12):  # owners of one shingle stand in order: left ones come first
        same = (c[step:] == c[:-step]) & (o[:-step] < len(left)) & (o[step:] >= len(left))
        np.add.at(out, (o[:-step][same], o[step:][same] - len(left)), 1)
    return out.astype(np.int64)


def _links(ids: list[int], comps: list[int], sets: list[np.ndarray], sides: list[int], percent: int, joined: UnionFind):
    """Links between the two blocks (or within one) that join components, found by exact comparison."""
    left = [i for i, s in enumerate(sides) if s != 1]
    right = left if 1 not in sides else [i for i, s in enumerate(sides) if s == 1]
    inter = intersections([sets[i] for i in left], [sets[i] for i in right])
    n = np.array([len(s) for s in sets])
    union = n[left][:, None] + n[right][None, :] - inter
    comp = np.array(comps)
    x, y = np.nonzero((100 * inter >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
    return [(ids[left[a]], ids[right[b]]) for a, b in zip(x.tolist(), y.tolist(), strict=True) if joined.union(comps[left[a]], comps[right[b]])]


def _compare(percent: int):
    """Compares whole groups; rows come sorted by (bucket, i, j), side 0 or 1 (of block i or j; 0 where they are one)."""

    def run(batches):
        key, rows = None, []
        joined = UnionFind()
        found: list[tuple[int, int]] = []

        def told():
            a = list(zip(*found, strict=True)) or [[], []]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64())], names=["a", "b"])

        def end():
            if len({joined.root(r[1]) for r in rows}) > 1:
                found.extend(_links([r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], percent, joined))

        for b in batches:
            bucket, i, j = (b.column(c).to_pylist() for c in ("bucket", "i", "j"))
            ids, comps, sides = (b.column(c).to_pylist() for c in ("id", "comp", "side"))
            shingles = b.column("shingles")
            values, offsets = shingles.values.to_numpy(), shingles.offsets.to_numpy()
            for r in range(b.num_rows):
                if (bucket[r], i[r], j[r]) != key:
                    end()
                    key, rows = (bucket[r], i[r], j[r]), []
                rows.append((ids[r], comps[r], sides[r], values[offsets[r] : offsets[r + 1]].copy()))
            if found:
                yield told()
        end()
        yield told()
        give_back()

    return run


def near_groups(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketches = materialize(texts.mapInArrow(_sketch(bands, rows, width), "doc_id long, n_shingles long, digest binary, keys array<long>"), "sketches")
    linked = sketches.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    groups = materialize(
        linked.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("n_shingles").alias("shingles")), "groups"
    )
    of_group = linked.select("digest", "doc_id", "keys").join(groups, "digest")
    members = materialize(
        of_group.where("doc_id = id").select(
            "id", "n", F.col("shingles").alias("length"), F.explode(F.array_distinct("keys")).alias("bucket")
        ).distinct(),
        "members"
    )
    # one doc_id with several texts: its groups belong together
    several = materialize(
        linked.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x != y").select("doc_id"), "several"
    )
    same = of_group.join(several, "doc_id", "left_semi").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    first = F.min(F.struct((-F.col("n")).alias("n"), "id", "length"))
    buckets = materialize(
        members.groupBy("bucket").agg(first.alias("x"), F.count("*").alias("size")).where("size > 1").select(
            "bucket", F.col("x.id").alias("centre"), F.col("x.length").alias("centre_length"), "size"
        ),
        "buckets"
    )
    placed = materialize(members.drop("n").join(buckets, "bucket"), "placed")
    # an intersection is at most the smaller set, a union at least the larger: other pairs can't be links, and their sets aren't moved
    near = 100 * F.least("length", "centre_length") >= percent * F.greatest("length", "centre_length")
    pairs = materialize(
        placed.where("id != centre").where(near).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs"
    )
    # members of larger buckets may be compared with each other later
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(placed.where("size > 2").select(F.col("id").alias("doc_id"))).distinct()
    sets = materialize(
        texts.join(materialize(wanted, "wanted"), "doc_id", "left_semi").mapInArrow(_sets(width), "id long, shingles array<long>"), "sets"
    )
    both = pairs.join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    ).join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    true = both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()
    links = materialize(true.unionByName(same), "links")
    found = materialize(connected_components(links), "components")

    named = lambda df: df.join(
        found.withColumnRenamed("node", "id"), "id", "left"
    ).withColumn("comp", F.coalesce("component", "id")).drop("component")
    open_ = named(placed.where("size > 2"))
    # buckets with the same members are compared once
    split = open_.groupBy("bucket").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("whole"),
        F.count("*").alias("members"), F.sum("length").alias("lengths")
    ).where("lo != hi")
    once = materialize(split.groupBy("whole", "members").agg(F.min("bucket").alias("bucket"), F.max("lengths").alias("lengths")), "open")
    todo = named(placed.join(once.select("bucket", "members", "lengths"), "bucket"))
    # blocks are bounded in members and in what their sets hold
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / block), F.ceil(F.col("lengths") / block_shingles)).cast("int")
    mine = todo.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "id"), "blocks").cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "id", "comp"
    )
    carried = dealt.join(sets, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = materialize(carried.mapInArrow(_compare(percent), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        found = materialize(connected_components(links.unionByName(more)), "components")
    of_set = materialize(
        groups.select("digest", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
            "digest", F.coalesce("component", "id").alias("component_id")
        ),
        "of_set"
    )
    out = sketches.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, with all its columns; of rows with the same doc_id and component, one."""
    groups = near_groups(docs, **how)
    gone = materialize(groups.where("NOT kept").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = materialize(groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(*docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again.dropDuplicates(["doc_id"]))
