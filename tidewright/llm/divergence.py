"""How sources of a language differ in their words: divergences of all pairs of sources, and the words that mark each.

Terms are runs of letters: ASCII letters, lower-cased, and all characters beyond ASCII. A language keeps the terms that
enough of its documents hold. For each pair of its sources the kept terms are tallied by their two counts; a term that one or both
sources lack is tallied with a zero, from the totals alone. The divergence is evaluated once for each combination of
counts and multiplied by how many terms have it. All arithmetic is on integers.

Nulls: a null text, language or source is the empty string. Each row is a document of its own, repeated rows too. A
group without terms has rows in the pairs; an empty table gives no rows. A text may be one term however long it is.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, byte_column, materialize, pieces

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms held by a task before they are sent on, and the most bytes of them.
HELD_TERMS, HELD_BYTES = 200_000, 16 << 20
#: Pieces that a language's groups are dealt to when they meet.
SALTS = 16
_LETTERS = bytes(c if c > 127 else (c | 32 if chr(c).isalpha() else 32) for c in range(256))
_KINDS = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "n": pa.int64(), "docs": pa.int64()}


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split()


def _tally(batches):
    """Counts of terms, and of documents that hold them, added up within a task until they fill its bound."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            if n:
                k = len(n)
                columns = [[lang] * k, [source] * k, list(n), list(n.values()), [docs[t] for t in n]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS.values(), strict=True)], names=list(_KINDS))

    for b in pieces(batches):
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), byte_column(b), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = Counter(terms(text))
            before = len(n)
            n.update(found)
            docs.update(found.keys())
            size += (len(n) - before) * 80 + (len(text) if len(text) > 50 * len(found) else 0)
            if size >= HELD_TERMS * 80 or size >= HELD_BYTES:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total (occurrences in the language) and sources, an array of (source, n), of the terms that are kept; written.

    One shuffle by language and term; a term's row holds a pair for each source.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(_tally, "lang string, source string, term binary, n long, docs long").repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")
    )
    return materialize(by_term.where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "total", "sources"), "kept-terms")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (occurrences of kept terms) of every group, with its language's total and number v of kept terms; written."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    joined = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    return materialize(joined.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("size", "lang_size", "v")]), "groups")


def share(count: Column, size: Column, v: Column) -> Column:
    """A smoothed share of ``count`` in ``size`` as an integer, a billion being all; exact for any 64-bit counts."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(count) + wide(F.lit(2))), wide(size) + wide(v) * wide(F.lit(2)))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """(p - q)^2 / (p + q), rounded down."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def meet(groups: DataFrame) -> DataFrame:
    """All pairs lo < hi of a language's sources, with their sizes; dealt out, so that a language of many sources isn't one task's."""
    salt = F.pmod(F.xxhash64("source"), F.lit(SALTS))
    lo = groups.select("lang", F.col("source").alias("lo"), F.col("size").alias("lo_size"), "v", salt.alias("salt"))
    hi = groups.select("lang", F.col("source").alias("hi"), F.col("size").alias("hi_size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return lo.join(hi, ["lang", "salt"]).where(F.col("lo") < F.col("hi")).drop("salt")


def joint_counts(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, lo, hi, a, b, terms: how many kept terms occur a times in lo and b times in hi, zeros included.

    Terms that both have are tallied; the others follow from each source's own tally and the number of kept terms.
    """
    at = kept.select("lang", "sources", F.posexplode("sources").alias("i", "x"))
    both = at.select("lang", "x", F.explode(F.slice("sources", F.col("i") + 2, F.size("sources"))).alias("y")).groupBy(
        "lang", F.col("x.source").alias("lo"), F.col("y.source").alias("hi"), F.col("x.n").alias("a"), F.col("y.n").alias("b")
    ).agg(F.count("*").alias("terms"))
    zero, n = F.lit(0).cast("long"), F.col("terms")
    shares = F.array(*[
        F.struct(a.alias("a"), b.alias("b"), m.alias("terms"))
        for a, b, m in ((F.col("a"), F.col("b"), n), (F.col("a"), zero, -n), (zero, F.col("b"), -n), (zero, zero, n))
    ])
    met = both.select("lang", "lo", "hi", F.inline(shares))
    own = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source", "s.n").agg(F.count("*").alias("terms"))
    alone = lambda side, a, b: pairs.select("lang", "lo", "hi").join(own.withColumnRenamed("source", side), ["lang", side]).select(
        "lang", "lo", "hi", F.inline(F.array(F.struct(a.alias("a"), b.alias("b"), n.alias("terms")), F.struct(zero.alias("a"), zero.alias("b"), (-n).alias("terms"))))
    )
    none = pairs.select("lang", "lo", "hi", zero.alias("a"), zero.alias("b"), F.col("v").alias("terms"))
    every = met.unionByName(alone("lo", F.col("n"), zero)).unionByName(alone("hi", zero, F.col("n"))).unionByName(none)
    return every.groupBy("lang", "lo", "hi", "a", "b").agg(F.sum("terms").alias("terms")).where(F.col("terms") != 0)


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item (another source), value: the divergence summed over all kept terms, both ways."""
    pairs = meet(groups)
    tally = joint_counts(kept, pairs).join(pairs, ["lang", "lo", "hi"])
    f = divergence(share(F.col("a"), F.col("lo_size"), F.col("v")), share(F.col("b"), F.col("hi_size"), F.col("v")))
    summed = tally.groupBy("lang", "lo", "hi").agg(F.sum(f * F.col("terms")).alias("value"))
    valued = pairs.join(summed, ["lang", "lo", "hi"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    ways = F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))
    return valued.select("lang", F.inline(ways), "value").withColumn("part", F.lit("pair"))


def marking_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item (a term commoner in the source than in its language), value: the term's part of the divergence."""
    deal = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    at = kept.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", "s.*").withColumn("salt", deal)
    known = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    shared = at.join(known, ["lang", "source", "salt"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("size"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("v")).alias("q")
    )
    return shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Both parts with ranks within each group: all pairs, and the ``top`` terms."""
    kept = kept_terms(docs, min_docs)
    groups = groups_of(docs, kept)
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    columns = ("lang", "source", "part", "item", "value")
    pairs = pair_divergences(kept, groups).select(*columns, rank)
    return pairs.unionByName(marking_terms(kept, groups).select(*columns, rank).where(F.col("rank") <= top))
