"""Which 64-bit keys may occur twice or more: a sharded Bloom filter whose cells count up to two.

Tasks set bits for their keys, shards add them up, and only the bits of cells hit twice come to the driver, at most
``most_bytes``, to be broadcast. A key hit once may be reported by chance; a repeated key always is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64

SHARD_BITS = 1 << 20
MOST_BYTES = 32 << 20


def cells(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each key, in one shard."""
    h = mix64(keys)
    base = (h >> np.uint64(44)).astype(np.int64) * shards // (1 << 20) * SHARD_BITS
    mask = np.uint64(SHARD_BITS - 1)
    return base + (h & mask).astype(np.int64), base + ((h >> np.uint64(20)) & mask).astype(np.int64)


def shards_for(n: int, most_bytes: int = MOST_BYTES) -> int:
    """Shards of a filter for about n keys; 0 where one of the allowed size would rule out too few."""
    wanted, most = max(1, -(-16 * n // SHARD_BITS)), max(1, most_bytes * 8 // SHARD_BITS)
    return 0 if wanted > 8 * most else min(wanted, most)


def _bits(keys_of: Callable[[Iterable], Iterable[np.ndarray]], shards: int):
    def run(batches):
        found = []
        for keys in keys_of(batches):
            a, b = cells(keys, shards)
            found += [a, b[a != b]]
        if not found:
            return
        at, counts = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.searchsorted(at, np.arange(shards + 1) * SHARD_BITS)
        rows = [(s, at[a:z] - s * SHARD_BITS, counts[a:z]) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _, _ in rows], pa.int32()),
                pa.array([c[n == 1].astype("<u4").tobytes() for _, c, n in rows], pa.binary()),
                pa.array([c[n > 1].astype("<u4").tobytes() for _, c, n in rows], pa.binary()),
            ],
            names=["shard", "once", "twice"],
        )

    return run


def _merge(table: pa.Table) -> pa.Table:
    once, twice = np.zeros(SHARD_BITS, bool), np.zeros(SHARD_BITS, bool)
    for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
        a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        twice[a[once[a]]] = True
        once[a] = True
        twice[b] = once[b] = True
    return pa.table(
        {"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())}
    )


def repeat_filter(df: DataFrame, keys_of: Callable[[Iterable], Iterable[np.ndarray]], n: int, most_bytes: int = MOST_BYTES) -> bytes | None:
    """The filter over the keys that ``keys_of`` yields for the batches of ``df``; None where every key must be taken as repeated."""
    if not (shards := shards_for(n, most_bytes)):
        return None
    merged = df.mapInArrow(
        _bits(keys_of, shards), "shard int, once binary, twice binary"
    ).groupBy("shard").applyInArrow(_merge, "shard int, bits binary")
    out = bytearray(shards * SHARD_BITS // 8)
    for r in merged.toLocalIterator():
        at = r["shard"] * SHARD_BITS // 8
        out[at : at + SHARD_BITS // 8] = r["bits"]
    return bytes(out)


def probe(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be repeated."""
    whole = np.frombuffer(bits, np.uint8)
    hit = lambda at: (whole[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    a, b = cells(keys, len(whole) * 8 // SHARD_BITS)
    return (hit(a) & hit(b)).astype(bool)
