"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Each document of size n words gets the rate w = min(2, exp(lambda * n / mean)), the rate nearest to 1 in
entropy among those that meet its source's token constraint and stay within 0..2. The multipliers are
the solution of the convex dual, found by Newton steps held in a bracket; each step is one aggregation
over the counts of (source, size), which are far fewer than the documents.

Rates become copies by sizes, the heaviest first. A class holds a source's documents of one size; its copies are what its
and the heavier classes' rates owe at that point, rounded, within what the lighter classes can still make up. So each error is
carried to lighter documents, and the last one left is half a document of the least size. Where the few heaviest documents
of a source leave more than that, other choices of their copies are searched (``HEAVY`` classes, ``WIDTH`` choices kept).
A class's copies are dealt evenly; the documents with one more are those whose hash of (doc_id, text) is at most a cut, the exact
order statistic, found by counts of the hash's leading bits and then within one bin. A document's copies follow from its size,
its hash and its class's two figures, in a map over the corpus, and reruns agree.

Sources stand by code point, null last, and weigh 3, 1, 2, repeating. They share ``share`` of all sizes;
no target is above twice its source's size, and the excess is shared anew by weight. Null and blank
texts have size 0 and are taken 0 times their words; a source or table without words has target 0. Rows of equal doc_id
and text have equal copies. Sources are tens or thousands (they are numbered in one task); a source's classes are bounded by
the longest text's words, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_CLASS, as_struct, materialize

MOST_COPIES = 2
#: Documents that a bin of hashes holds on average, where a class is cut.
PER_BIN = 1024
#: Classes whose copies are searched where plain rounding misses, choices kept after each, and the miss that starts a search.
HEAVY, WIDTH, NEAR = 24, 32, 1e-4
#: Classes rounded before their figures are put by (arrays are copied as they grow).
CHUNK = 512
#: Rows of the class table up to which it is broadcast (about 60 bytes each).
MOST_BROADCAST = 200_000
_HASH_BITS = 62


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> DataFrame:
    """source, sid, source_size, target of each source; ``sizes`` has source and size.

    With ceilings c and weights w, the excess ends shared at one level t with target min(c, t w). Over the
    sources by c / w, t is the largest of what is left for a source and those after it, a unit of weight.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = by_source.withColumn("sid", F.row_number().over(every) - 1)
    weighed = numbered.withColumn(
        "weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ).withColumn("ceiling", (MOST_COPIES * F.col("source_size")).cast("double"))
    rising = W.orderBy(F.col("ceiling") / F.col("weight"), "sid")
    rest = rising.rowsBetween(0, W.unboundedFollowing)
    done = F.coalesce(F.sum("ceiling").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    whole = W.partitionBy()
    level = F.max("level").over(whole)
    leveled = weighed.withColumn("level", (share * F.sum("source_size").over(whole) - done) / F.sum("weight").over(rest))
    return leveled.withColumn(
        "target", F.greatest(F.lit(0.0), F.least("ceiling", level * F.col("weight")))
    ).select("source", "sid", "source_size", "target")


def _rate(size: Column, mean: Column, lam: Column) -> Column:
    return F.least(F.lit(float(MOST_COPIES)), F.exp(lam * size / mean))


def solve(counts: DataFrame, per_source: DataFrame, steps: int = 40, close: float = 1e-6) -> DataFrame:
    """``per_source`` with ``mean`` and ``lam``; counts has sid, size (1 or more) and n. Raises where ``steps`` don't reach ``close``."""
    means = counts.groupBy("sid").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("heavy")
    )
    start = per_source.join(means, "sid", "left").withColumn("mean", F.coalesce("mean", F.lit(1.0)))
    # at the bracket's ends every document has the most copies, or next to none
    start = start.withColumns({"lo": -60.0 * F.col("mean"), "hi": F.log(F.lit(float(MOST_COPIES))) * F.col("mean")})
    full = F.col("target") >= MOST_COPIES * F.col("source_size")
    start = start.withColumn(
        "lam",
        F.when(full, F.col("hi")).when(
            F.col("source_size") > 0,
            F.greatest("lo", F.least("hi", F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size")) * F.col("mean") / F.col("heavy")))
        ).otherwise(F.lit(0.0))
    )
    state = materialize(start.withColumn("off", F.lit(1.0)).drop("heavy"), "dual")
    for _ in range(steps):
        at = counts.join(state.select("sid", "mean", "lam"), "sid")
        w, tokens = _rate(F.col("size"), F.col("mean"), F.col("lam")), F.col("size") * F.col("n")
        sums = at.groupBy("sid").agg(
            F.sum(tokens * w).alias("got"), F.sum(F.when(w < MOST_COPIES, tokens * w * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")
        )
        f = F.col("got") - F.col("target")
        lo, hi = F.when(f < 0, F.col("lam")).otherwise(F.col("lo")), F.when(f > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, F.col("lam") - f / F.col("slope"))
        off = F.abs(f) / F.greatest(F.col("target"), F.lit(1.0))
        moved = state.join(sums, "sid", "left").withColumns({"_lo": lo, "_hi": hi, "_step": step, "off": F.coalesce(off, F.lit(0.0))})
        inside = (F.col("_step") > F.col("_lo")) & (F.col("_step") < F.col("_hi"))
        lam = F.when(F.col("off") <= close, F.col("lam")).when(inside, F.col("_step")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = materialize(
            moved.select(
                "source", "sid", "source_size", "target", "mean", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), lam.alias("lam"), "off"
            ),
            "dual"
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= close:
            break
    else:
        raise RuntimeError(f"the dual did not converge in {steps} steps")
    return state.select("source", "sid", "source_size", "target", "mean", "lam")


def _draw(doc_id: Column, text: Column) -> Column:
    """A number of 62 bits that doc_id and text decide."""
    return F.pmod(F.xxhash64(F.lit(20011), doc_id, text.cast("string")), F.lit(1 << _HASH_BITS))


def _share(rem: Column, rest: Column, ideal: Column, c: Column) -> Column:
    """A class's copies: what is owed, rounded, such that the lighter classes (``rest`` words, of which ``ideal`` by their rates) can make up what remains."""
    size = c["size"].cast("double")
    low, high = F.ceil((rem - MOST_COPIES * rest) / size), F.floor(rem / size)
    within = F.greatest(low, F.least(high, F.round((rem - ideal) / size).cast("long")))
    # no whole number fits: one less leaves too much for the rest, one more exceeds the target
    nearest = F.when((high + 1) * size - rem < rem - high * size - MOST_COPIES * rest, high + 1).otherwise(high)
    return F.greatest(F.lit(0).cast("long"), F.least(MOST_COPIES * c["n"], F.when(low <= high, within).otherwise(nearest)))


def _lighter(c: Column, rest: Column, ideal: Column) -> tuple[Column, Column]:
    return rest - c["size"] * c["n"], ideal - c["ideal"]


def _miss(state: Column, classes: Column) -> Column:
    """What plain rounding of ``classes`` from ``state`` (rem, rest, ideal) leaves of the target."""

    def step(s, c):
        rest, ideal = _lighter(c, s["rest"], s["ideal"])
        return F.struct((s["rem"] - _share(s["rem"], rest, ideal, c) * c["size"]).alias("rem"), rest.alias("rest"), ideal.alias("ideal"))

    return F.aggregate(classes, state, step, lambda s: s["rem"])


def _round(state: Column, classes: Column) -> Column:
    """The copies of each of ``classes``, rounded one after the other from ``state``."""
    longs = F.array().cast("array<bigint>")

    def step(s, c):
        rest, ideal = _lighter(c, s["rest"], s["ideal"])
        k = _share(s["rem"], rest, ideal, c)
        return F.struct((s["rem"] - k * c["size"]).alias("rem"), rest.alias("rest"), ideal.alias("ideal"), F.array_append(s["got"], k).alias("got"))

    def chunk(s, i):
        start = F.struct(s["rem"].alias("rem"), s["rest"].alias("rest"), s["ideal"].alias("ideal"), longs.alias("got"))
        done = F.aggregate(F.slice(classes, i * CHUNK + 1, F.lit(CHUNK)), start, step)
        put = lambda d: F.struct(
            d["rem"].alias("rem"), d["rest"].alias("rest"), d["ideal"].alias("ideal"), F.array_append(s["got"], d["got"]).alias("got")
        )
        return F.element_at(F.transform(F.array(done), put), 1)

    start = F.struct(
        state["rem"].alias("rem"), state["rest"].alias("rest"), state["ideal"].alias("ideal"), F.array().cast("array<array<bigint>>").alias("got")
    )
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(classes) / CHUNK).cast("int")), start, chunk, lambda s: s["got"]))


def _search(state: Column, classes: Column) -> Column:
    """array<struct<off, rem, rest, ideal, got>> of choices for the heaviest classes, those nearest to the rates first."""
    longs = F.array().cast("array<bigint>")

    def step(s, c):
        rest, ideal = _lighter(c, s["rest"], s["ideal"])

        def choices(e):
            k = _share(e["rem"], rest, ideal, c)
            fit = F.filter(F.array(k - 1, k, k + 1), lambda x: (x >= 0) & (x <= MOST_COPIES * c["n"]))

            def taken(x):
                rem = e["rem"] - x * c["size"]
                return F.struct(
                    F.greatest(-rem, rem - MOST_COPIES * rest, F.lit(0.0)).alias("out"), F.abs(rem - ideal).alias("off"), rem.alias("rem"),
                    F.array_append(e["got"], x).alias("got")
                )

            return F.transform(fit, taken)

        return F.struct(
            rest.alias("rest"), ideal.alias("ideal"), F.slice(F.array_sort(F.flatten(F.transform(s["kept"], choices))), 1, WIDTH).alias("kept")
        )

    zero = F.lit(0.0)
    start = F.struct(
        state["rest"].alias("rest"), state["ideal"].alias("ideal"),
        F.array(F.struct(zero.alias("out"), zero.alias("off"), state["rem"].alias("rem"), longs.alias("got"))).alias("kept")
    )
    each = lambda s: F.transform(
        s["kept"], lambda e: F.struct(e["rem"].alias("rem"), s["rest"].alias("rest"), s["ideal"].alias("ideal"), e["got"].alias("got"))
    )
    return F.aggregate(F.slice(classes, 1, HEAVY), start, step, each)


def class_copies(counts: DataFrame, solved: DataFrame) -> DataFrame:
    """source, size, n, total: the copies of all documents of one size in a source. ``counts`` has sid, size and n."""
    ideal = _rate(F.col("size"), F.col("mean"), F.col("lam")) * F.col("size") * F.col("n")
    of_source = counts.join(solved, "sid").groupBy("sid").agg(
        F.sort_array(F.collect_list(F.struct("size", "n", ideal.alias("ideal"))), asc=False).alias("classes"), F.first("source").alias("source"),
        F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    state = F.struct(F.col("target").alias("rem"), F.col("source_size").cast("double").alias("rest"), F.col("target").alias("ideal"))
    of_source = materialize(
        of_source.select("source", "classes", state.alias("state")).withColumn("miss", F.abs(_miss(F.col("state"), F.col("classes")))), "classes"
    )
    least = F.element_at("classes", -1)["size"]
    near = F.greatest(least / 2.0, NEAR * F.col("state.rem"))
    plain = of_source.where(F.col("miss") <= near).select("source", "classes", _round(F.col("state"), F.col("classes")).alias("total"))
    light = F.slice("classes", HEAVY + 1, F.greatest(F.size("classes") - HEAVY, F.lit(0)))
    searched = of_source.where(F.col("miss") > near).withColumn("choices", _search(F.col("state"), F.col("classes")))
    searched = searched.withColumn(
        "ends",
        F.transform(
            "choices",
            lambda e, i: F.struct(
                F.greatest(
                    F.abs(_miss(F.struct(e["rem"].alias("rem"), e["rest"].alias("rest"), e["ideal"].alias("ideal")), light)) - near, F.lit(0.0)
                ).alias("over"),
                i.alias("i")
            )
        )
    )
    searched = materialize(searched.withColumn("best", F.element_at("choices", F.array_min("ends")["i"] + 1)).withColumn("light", light), "searched")
    sought = searched.select(
        "source", "classes", F.concat("best.got", _round(F.struct("best.rem", "best.rest", "best.ideal"), F.col("light"))).alias("total")
    )
    each = plain.unionByName(sought).select("source", F.explode(F.arrays_zip("classes", "total")).alias("c"))
    return each.select("source", "c.classes.size", "c.classes.n", F.col("c.total").alias("total"))


def _at_most(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """``df``, to be broadcast where it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _same_class(left: DataFrame, classes: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` (source, size) with the columns of ``classes`` but its keys."""
    right = _at_most(classes.withColumnsRenamed({"source": "_of", "size": "_words"}))
    return left.join(right, F.col("source").eqNullSafe(F.col("_of")) & (F.col("size") == F.col("_words")), how).drop("_of", "_words")


def plan(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """The sources' targets, and source, size, base, cut of each class; ``sized`` has source, size and draw.

    A document of a class is taken ``base`` times, and once more where its draw is at most ``cut`` (-1: none is).
    """
    per_source = materialize(targets(sized, weights, share), "targets")
    named = per_source.select(F.col("source").alias("_source"), "sid")
    keyed = sized.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("_source")))
    counts = materialize(keyed.groupBy("sid", "size").agg(F.count("*").alias("n")), "counts")
    classes = class_copies(counts, solve(counts, per_source))
    classes = materialize(
        classes.select(
            "source", "size", "n", F.floor(F.col("total") / F.col("n")).cast("int").alias("base"), (F.col("total") % F.col("n")).alias("extra")
        ),
        "rounded"
    )

    halvings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PER_BIN))).cast("int")
    cut = classes.where("extra > 0").select("source", "size", "extra", (F.lit(_HASH_BITS) - halvings).alias("shift"))
    placed = _same_class(sized.select("source", "size", "draw"), cut).withColumn("bin", F.call_function("shiftright", F.col("draw"), F.col("shift")))
    filled = placed.groupBy("source", "size", "extra", "bin").agg(F.count("*").alias("c"))
    upto = W.partitionBy("source", "size").orderBy("bin")  # about n / PER_BIN rows of one class
    bins = materialize(
        filled.withColumn("upto", F.sum("c").over(upto)).where(
            (F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("c") < F.col("extra"))
        ).select(
            "source", "size", (F.col("extra") - F.col("upto") + F.col("c")).alias("rank"), F.col("bin").alias("_bin")
        ),
        "bins"
    )
    inside = W.partitionBy("source", "size").orderBy("draw")  # the rows of one bin
    among = _same_class(placed.select("source", "size", "draw", "bin"), bins).where("bin = _bin").withColumn("i", F.row_number().over(inside))
    cuts = among.where("i = rank").select(F.col("source").alias("_of"), F.col("size").alias("_words"), F.col("draw").alias("cut"))
    of_class = classes.join(cuts, F.col("source").eqNullSafe(F.col("_of")) & (F.col("size") == F.col("_words")), "left")
    return per_source, materialize(of_class.select("source", "size", "base", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")


def _copies() -> Column:
    return F.coalesce(F.col("base") + F.when(F.col("draw") <= F.col("cut"), 1).otherwise(0), F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each document."""
    sized = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(F.col("doc_id"), F.col("text")).alias("draw")), "sized"
    )
    per_source, classes = plan(sized, weights, share)
    every = _same_class(sized, classes, "left").withColumn("copies", _copies())
    figures = per_source.select(F.col("source").alias("_source"), "source_size", "target")
    every = every.join(figures, F.col("source").eqNullSafe(F.col("_source")))
    return every.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def draw_mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken. Texts are shuffled only where there are more than ``MOST_BROADCAST`` classes."""
    size, draw = word_count(F.col("text")), _draw(F.col("doc_id"), F.col("text"))
    _, classes = plan(materialize(docs.select("source", size.alias("size"), draw.alias("draw")), "sized"), weights, share)
    whole = docs.select(as_struct(docs, "_doc"), F.col("source"), size.alias("size"), draw.alias("draw"))
    copies = _same_class(whole, classes).select("_doc", _copies().alias("copies"))
    return copies.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_doc.*")
