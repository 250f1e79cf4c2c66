"""Exact deduplication by two passes over Bloom filters.

Pass 1 reads each text once, writes (doc_id, digest, length) to the shared folder and sets bits of
a sharded filter whose cells count up to two. A document whose cells have all been hit twice is
possibly repeated. Pass 2 probes the filter: rows it rules out pass straight through without a
shuffle; only possible repeats are shuffled by digest, where full SHA-256 digests decide.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Of equal texts
the row with the most code points in its original text stays, then the smallest doc_id (null last),
then the first row read. A null text counts as empty; empty texts are equal to each other. Each
input row is reported once, repeated rows too, and exactly one row of a group is kept.

The filter is broadcast and never above ``max_filter_bytes``. Where the corpus is too large for a
filter of that size to rule anything out, it isn't built and every digest row (about 60 bytes, no
text) is shuffled: the result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, as_struct, byte_column, byte_list, materialize, pieces
from .repeats import MOST_BYTES, probe, repeat_filter

def digest_of(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, SPACE_BYTES)).digest()


def _digests(batches):
    for b in pieces(batches):
        texts = byte_column(b)
        n = pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("_row"), pa.array([digest_of(t) for t in texts], pa.binary()), n], names=["doc_id", "_row", "_sha", "_len"]
        )


def _keys(shas: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(shas), "<u8").reshape(-1, 4)[:, 0].copy()


def _keys_of(batches):
    for b in batches:
        yield _keys(b.column("_sha").to_pylist())


def _probe(bits):
    def run(batches):
        for b in batches:
            yield b.append_column("_maybe", pa.array(probe(bits.value, _keys(b.column("_sha").to_pylist()))))

    return run


def exact_groups(docs: DataFrame, max_filter_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    digests = materialize(rows.mapInArrow(_digests, "doc_id long, _row long, _sha binary, _len long"), "digests")
    bits = repeat_filter(digests.select("_sha"), _keys_of, digests.count(), max_filter_bytes)
    if bits is None:
        alone, maybe = None, digests
    else:
        probed = digests.mapInArrow(_probe(spark.sparkContext.broadcast(bits)), "doc_id long, _row long, _sha binary, _len long, _maybe boolean")
        alone, maybe = probed.where(~F.col("_maybe")), probed.where("_maybe")
    best = F.min(F.struct((-F.col("_len")).alias("n"), F.col("doc_id").isNull().alias("absent"), "doc_id", "_row"))
    # a table of its own, so that both sides of the join are exchanges and a large group's rows can be split
    groups = materialize(maybe.groupBy("_sha").agg(best.alias("_best"), F.count("*").alias("group_size")), "groups")
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256")]
    found = maybe.join(groups, "_sha").select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "_sha"
    ).select(*out)
    if alone is None:
        return found
    passed = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha"
    ).select(*out)
    return passed.unionByName(found)


def _with_digest(batches):
    for b in pieces(batches):
        text = pc.struct_field(b.column("_doc"), "text").cast(pa.string())
        n = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
        yield b.append_column("_sha", pa.array([digest_of(t) for t in byte_list(text)], pa.binary())).append_column("_len", n)


def drop_exact_duplicates(docs: DataFrame, max_filter_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents that stay, with their columns, whatever their names. Texts that the filter rules out are never shuffled."""
    spark = docs.sparkSession
    whole = docs.select(as_struct(docs, "_doc"))
    kinds = whole.limit(0).withColumns({"_sha": F.lit(None).cast("binary"), "_len": F.lit(None).cast("long")})
    full = whole.mapInArrow(_with_digest, kinds.schema)
    digests = materialize(full.select(F.col("_doc.doc_id").alias("doc_id"), "_sha", "_len"), "digests")
    bits = repeat_filter(digests.select("_sha"), _keys_of, digests.count(), max_filter_bytes)
    id_ = F.col("_doc.doc_id")
    rank = lambda i: F.struct((-F.col("_len")).alias("n"), i.isNull().alias("absent"), i.alias("id"))
    if bits is None:
        alone, maybe, keys = None, full, digests
    else:
        at = spark.sparkContext.broadcast(bits)
        probed = full.mapInArrow(_probe(at), kinds.withColumn("_maybe", F.lit(None).cast("boolean")).schema)
        alone, maybe = probed.where(~F.col("_maybe")).select("_doc.*"), probed.where("_maybe")
        keys = digests.mapInArrow(_probe(at), "doc_id long, _sha binary, _len long, _maybe boolean").where("_maybe")
    best = materialize(keys.groupBy("_sha").agg(F.min(rank(F.col("doc_id"))).alias("_best")), "groups")
    # by doc_id too, so that the copies of a hot text are spread; more than one row is left only of repeated rows
    first = best.select(F.col("_sha").alias("_of"), (-F.col("_best.n")).alias("_most"), F.col("_best.id").alias("_id"))
    mine = (F.col("_sha") == F.col("_of")) & (F.col("_len") == F.col("_most")) & id_.eqNullSafe(F.col("_id"))
    kept = maybe.join(first, mine, "left_semi").dropDuplicates(["_sha"]).select("_doc.*")
    return kept if alone is None else alone.unionByName(kept)
