"""How filters interact: what each removes in every order of application, and what it shares with the others.

Each document has a mask of the filters that it fails. Documents are counted by part and mask first (at most 2^n cells a
part for n filters), so that what follows doesn't grow with the documents: cells are set against the steps of all
orders in long form, a running bit-or over the earlier steps tells which cells are gone before a step, and sums under
conditions give the counts of each step. Shapley totals are window sums of ``removed`` over all orders of a filter.

Nulls: a null text is empty and a null part the empty string; a null doc_id has no smaller doc_id and is none, so it
neither fails by repetition nor makes others fail. Repeated rows count as often as they occur. Labels of a doc_id that has
several rows there hold if one row has them. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import bound_batches, byte_column, materialize, pieces

#: The filters of ``fail_masks``, by bit: too few words, too few different words, capitals, symbols, repeated text.
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 100, 80, 10
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
MOST_FILTERS = 7


def text_mask(text: bytes, points: int) -> int:
    """The bits of the filters that look at a text alone."""
    words = text.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, CAPITALS))) > MAX_CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _judge(batches):
    for b in pieces(batches):
        texts = byte_column(b)
        points = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("part"), pa.array(map(text_mask, texts, points), pa.int32()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            ],
            names=["doc_id", "part", "mask", "digest"],
        )


def fail_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and mask of each row of ``docs``; bit i is set where the row fails filter ``LETTERS[i]``.

    Texts are read once; small rows are written, and repetition is found on them. The first of equal texts is met by digest and doc_id
    together, so that a text with very many copies doesn't meet in one task.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    judged = materialize(texts.mapInArrow(_judge, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return judged.join(firsts, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(repeats.cast("int") * 16).alias("mask")
    )


def with_labels(masks: DataFrame, labels: DataFrame, **flags: Column) -> DataFrame:
    """``masks`` with a boolean column for each flag, a condition on the columns of ``labels``; false without labels."""
    held = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in flags.items()])
    return masks.join(held, "doc_id", "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in flags})


def order_steps(letters: str) -> Column:
    """All orders of the filters in long form: filter_order, step from 1, and the bit of the step's filter."""
    steps = [(o, i + 1, 1 << letters.index(x)) for o in map("".join, permutations(letters)) for i, x in enumerate(o)]
    kind = T.ArrayType(T.StructType([T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("bit", T.IntegerType())]), False)
    return F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"bit":{b}}}' for o, s, b in steps) + "]"), kind)


def interactions(masks: DataFrame, letters: str = LETTERS, lost: dict[str, str] | None = None) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, shapley and lost counts.

    ``masks`` has part and mask; ``lost`` names a boolean column of it for each column that counts removed rows of this kind.
    """
    if not 0 < len(set(letters)) == len(letters) <= MOST_FILTERS:
        raise ValueError(f"give 1 to {MOST_FILTERS} different letters, as all their orders are taken")
    lost = lost or {}
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(k) for k, c in lost.items()])
    long = cells.select("*", F.explode(order_steps(letters)).alias("s")).select("*", "s.*").drop("s")
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    met = long.withColumns({
        "fails": F.col("mask").bitwiseAND(F.col("bit")) != 0,
        "gone": F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0)) != 0,
    })
    counted = lambda when, of="n": F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0))
    fails, gone = F.col("fails"), F.col("gone")
    steps = met.groupBy("part", "filter_order", "step", "bit").agg(
        counted(~fails & ~gone).alias("kept"), counted(fails & ~gone).alias("removed"), counted(fails & gone).alias("redundant"),
        counted(F.col("mask") == F.col("bit")).alias("unique_fails"), *[counted(fails & ~gone, k).alias(k) for k in lost]
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters by language, with the good and the toxic documents that each step loses."""
    flags = {"good": F.col("quality") == 1, "bad": F.col("toxic") == 1}
    return interactions(with_labels(fail_masks(docs), labels, **flags), lost={"good_lost": "good", "toxic_lost": "bad"})
