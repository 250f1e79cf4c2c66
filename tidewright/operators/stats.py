"""Statistics of features against presence (OP-46 to 62, 68 to 72, 79)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import effect_label, outside, stars
from ..schema import PLAUSIBLE
from ..sources.tables import scratch, stage
from .ordering import quantiles, running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def long_form(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """One row for each column of a row: variable, value."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), columns, "variable", "value") if columns else df


def class_balance(df: DataFrame, label: str = "Presence", low: float = 3.5, high: float = 4.5) -> DataFrame:
    """OP-46: presences, absences, their ratio (0 without presences) and whether it is as expected."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("n_presence"), F.count_if(F.col(label) == 0).alias("n_absence"))
    r = ratio(F.col("n_absence").cast("double"), F.col("n_presence"))
    return n.withColumn("ratio", r).withColumn("ok", F.col("ratio").between(low, high))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """OP-47: valid and missing rows of each variable, percentage valid and its status."""
    agg = df.agg(F.count("*").alias("_n"), *[F.count(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in columns])
    out = agg.unpivot(["_n"], columns, "variable", "valid").select(
        "variable", "valid", (F.col("_n") - F.col("valid")).alias("missing"), (100.0 * ratio(F.col("valid").cast("double"), F.col("_n"))).alias("pct")
    )
    return out.withColumn("status", F.when(F.col("pct") > 90, "ok").when(F.col("pct") > 50, "warn").otherwise("bad"))


def plausibility(df: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """OP-48, 31: range, mean and rows outside the limits of each variable that has values."""
    limits = limits or PLAUSIBLE
    parts = [
        F.struct(
            F.lit(c).alias("variable"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
            F.count_if(outside(F.col(c), *limits[c])).alias("outliers"), ((F.min(c) >= limits[c][0]) & (F.max(c) <= limits[c][1])).alias("in_range")
        ) for c in limits
    ]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x")).where(F.col("min").isNotNull())


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """OP-49: min, max and mean of each variable."""
    return long_form(df, columns).groupBy("variable").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def quantile_edges(df: DataFrame, column: str, q: int) -> DataFrame:
    """OP-68: one row with the distinct exact q-quantile edges; none without values."""
    return quantiles(df, [column], [i / q for i in range(q + 1)]).select(F.array_distinct("at").alias("edges"))


def _in_bin(df: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    below = F.size(F.filter("edges", lambda e: e < F.col(column)))
    return df.join(F.broadcast(edges), how="left").withColumn("bin", F.when(F.col(column).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("edges")


def quantile_bins(df: DataFrame, column: str, q: int = 10) -> DataFrame:
    """OP-68: ``bin`` of each row's value: right-closed quantile bins, the lowest value included, equal edges merged. Missing values have none."""
    return _in_bin(df, column, quantile_edges(df, column, q))


def bin_label(low: Column, high: Column, digits: int = 2) -> Column:
    """OP-69: the two edges of a bin as text, rounded to so many decimals."""
    return F.format_string(f"%.{digits}f-%.{digits}f", low, high)


def binned_rate(df: DataFrame, column: str, q: int = 10, label: str = "Presence", by: tuple[str, ...] = ()) -> DataFrame:
    """OP-51, 52, 69: presence rate in each bin (and group), with the bin's edges, midpoint and label. The edges are found once."""
    used = df.where(F.col(column).isNotNull())
    edges = stage(quantile_edges(used, column, q), scratch(df.sparkSession, "edges"))
    rates = _in_bin(used, column, edges).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    lo, hi = F.element_at("edges", F.col("bin") + 1), F.coalesce(F.try_element_at("edges", F.col("bin") + 2), F.element_at("edges", -1))
    return rates.crossJoin(F.broadcast(edges)).select(
        *by, "bin", lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("mid"), bin_label(lo, hi).alias("label"), "n", "rate"
    )


def peak_bin(rates: DataFrame) -> DataFrame:
    """OP-55: the bin with the highest rate, the first of equals."""
    return rates.agg(F.max_by("bin", F.struct("rate", -F.col("bin"))).alias("bin"), F.max("rate").alias("rate"))


def pivot_rates(df: DataFrame, row: str, column: str, values: list, label: str = "Presence") -> DataFrame:
    """OP-53: mean of the label by two keys, one column for each of ``values``."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(F.col(label).cast("double")))


def month_counts(df: DataFrame, date: str = "Date") -> DataFrame:
    """OP-54: rows of each month, zero-filled."""
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    n = df.groupBy(F.month(date).alias("month")).agg(F.count("*").alias("n"))
    return months.join(n, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def month_extremes(df: DataFrame, date: str = "Date") -> DataFrame:
    """OP-55: the months with most and fewest rows, the earlier of equals; months without rows don't count."""
    n = df.where(F.col(date).isNotNull()).groupBy(F.month(date).alias("month")).agg(F.count("*").alias("n"))
    return n.agg(
        F.max_by("month", F.struct("n", -F.col("month"))).alias("peak_month"), F.max("n").alias("peak_n"),
        F.min_by("month", F.struct("n", "month")).alias("low_month"), F.min("n").alias("low_n")
    )


def enrichment(
    df: DataFrame, depth: tuple[float, float] = (50.0, 200.0), label: str = "Presence", bathymetry: str = "Bathymetry",
    front: str = "Is_Thermal_Front"
) -> DataFrame:
    """OP-57: share in a depth band, on a front, and both, for each class, and the classes' quotient.

    The depth share is of rows with a depth, the other two are of all rows.
    """
    band = F.coalesce(F.abs(bathymetry).between(*depth), F.lit(False))
    on = F.coalesce(F.col(front).cast("boolean"), F.lit(False))
    pct = lambda a, b: 100.0 * ratio(a.cast("double"), b)
    n, known = F.count("*"), F.count(bathymetry)
    by = df.groupBy(label).agg(
        pct(F.count_if(band), known).alias("depth"), pct(F.count_if(on), n).alias("front"), pct(F.count_if(band & on), n).alias("both")
    )
    flat = by.unpivot([label], ["depth", "front", "both"], "measure", "pct")
    both = flat.groupBy("measure").agg(
        F.max(F.when(F.col(label) == 1, F.col("pct"))).alias("pct_presence"), F.max(F.when(F.col(label) == 0, F.col("pct"))).alias("pct_absence")
    )
    return both.withColumn("factor", F.when(F.col("pct_absence") > 0, F.col("pct_presence") / F.col("pct_absence")))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """OP-58: Pearson correlation of each pair over rows that have both; NULL where one of the two is constant. One pass."""
    cols = [F.col(c).cast("double") for c in columns]
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                both = a.isNotNull() & b.isNotNull()
                x, y = F.when(both, a), F.when(both, b)
                n, dx, dy = F.count(x), F.stddev_pop(x), F.stddev_pop(y)
                r = F.when((n > 1) & (dx > 0) & (dy > 0), F.covar_pop(x, y) / F.nullif(dx * dy, F.lit(0.0)))
                pairs.append(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), r.alias("r"), n.alias("n")))
    return df.agg(F.array(*pairs).alias("x")).select(F.inline("x"))


def strong_correlations(corr: DataFrame, least: float = 0.3, flag: float = 0.5) -> DataFrame:
    """OP-59."""
    return corr.where(F.abs("r") > least).withColumn("high", F.abs("r") > flag)


def histogram(df: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """OP-60: density in equal bins from the least to the greatest value, the last closed. A constant column spans one unit around it."""
    v = F.col(column)
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("total"))
    span = span.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total"
    )
    width = (F.col("hi") - F.col("lo")) / bins
    n = df.where(v.isNotNull()).crossJoin(F.broadcast(span)).groupBy(
        F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(n, "bin", "left").crossJoin(F.broadcast(span)).select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("total") * width)).alias("density")
    )


def kde(df: DataFrame, column: str, points: int = 200, pad: float = 0.0) -> DataFrame:
    """OP-61: Gaussian density at equal steps over the range, Scott's bandwidth.

    Each distinct value adds to a fixed number of points within its task; a task sends ``points`` sums, whatever its rows.
    """
    v = F.col(column).cast("double")
    s = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("total"), F.stddev_samp(v).alias("sd"))
    s = s.withColumn("h", F.nullif(F.col("sd"), F.lit(0.0)) * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
    values = df.where(v.isNotNull()).select(v.alias("v")).groupBy("v").agg(F.count("*").alias("c")).crossJoin(F.broadcast(s)).where("h IS NOT NULL")

    def sums(batches):
        total = at = None
        for b in batches:
            x, c = b.column("v").to_numpy(), b.column("c").to_numpy().astype(float)
            if not len(x):
                continue
            lo, hi, h = (b.column(k)[0].as_py() for k in ("lo", "hi", "h"))
            at = lo - pad + (hi - lo + 2 * pad) * np.arange(points) / (points - 1)
            total = np.zeros(points) if total is None else total
            for i in range(0, len(x), 4096):
                z = (at[:, None] - x[None, i : i + 4096]) / h
                total += np.exp(-z * z / 2) @ c[i : i + 4096]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(at), pa.array(total)], names=["i", "x", "part"])

    met = values.mapInArrow(sums, "i int, x double, part double").groupBy("i").agg(F.first("x").alias("x"), F.sum("part").alias("part"))
    return met.crossJoin(F.broadcast(s)).select("i", "x", (F.col("part") / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


#: Of ``kde_2d``: width of a bin in bandwidths, moments of a bin up to this degree, and bandwidths beyond which a bin adds nothing.
BIN, DEGREE, REACH = 0.5, 9, 9.0


def kde_2d(df: DataFrame, a: str, b: str, points: int = 20) -> DataFrame:
    """OP-62: Gaussian density in two dimensions on a lattice over the range, bandwidth n**(-1/6) times the covariance, of all rows.

    In coordinates in which the kernel is round, rows are added up by bins of half a bandwidth, as moments about the bin's centre, in one
    aggregation; then each occupied bin adds its Hermite series to the lattice, so that the second step's cost follows the bins,
    whose number grows with the cube root of the rows at most, and a task sends a row for each lattice point. A row's part is off by less than
    ``kde_2d_error()`` times the kernel's peak, and so is their mean, the density. Without spread in two directions the density is NULL.
    """
    used = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v"))
    s = used.agg(
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count("*").alias("n"),
        F.var_samp("u").alias("uu"), F.var_samp("v").alias("vv"), F.covar_samp("u", "v").alias("uv")
    ).first()
    spark = df.sparkSession
    kind = "cell long, x double, y double, density double"
    if not s["n"]:
        return spark.createDataFrame([], kind)
    i, j = np.divmod(np.arange(points * points), points)
    x, y = s["u0"] + (s["u1"] - s["u0"]) * i / (points - 1), s["v0"] + (s["v1"] - s["v0"]) * j / (points - 1)
    scale = s["n"] ** (-1 / 3)
    uu, vv, uv = ((s[c] or 0.0) * scale for c in ("uu", "vv", "uv"))
    if not uu * vv - uv * uv > 1e-12 * uu * vv:
        return spark.createDataFrame([(int(k), float(x[k]), float(y[k]), None) for k in range(points * points)], kind)
    l11 = math.sqrt(uu)
    l21 = uv / l11
    l22 = math.sqrt(vv - l21 * l21)
    round_ = lambda u, v: ((u - s["u0"]) / l11, (v - s["v0"] - l21 * ((u - s["u0"]) / l11)) / l22)
    p, q = round_(F.col("u"), F.col("v"))
    binned = used.select(p.alias("p"), q.alias("q")).withColumns({"i": F.floor(F.col("p") / BIN), "j": F.floor(F.col("q") / BIN)})
    off = binned.select("i", "j", (F.col("p") - (F.col("i") + 0.5) * BIN).alias("d"), (F.col("q") - (F.col("j") + 0.5) * BIN).alias("e"))
    for c in "de":  # powers over factorials, each from the one before
        for k in range(2, DEGREE + 1):
            off = off.withColumn(f"{c}{k}", F.col(f"{c}{k - 1}" if k > 2 else c) * F.col(c) / k)
    power = lambda c, k: F.lit(1.0) if not k else F.col(c if k == 1 else f"{c}{k}")
    terms = [(m, k) for m in range(DEGREE + 1) for k in range(DEGREE + 1 - m)]
    bins = off.groupBy("i", "j").agg(F.array(*[F.sum(power("d", m) * power("e", k)) for m, k in terms]).alias("moments"))
    tx, ty = round_(x, y)

    def hermite(t: np.ndarray) -> list[np.ndarray]:
        h = [np.exp(-t * t / 2)]
        h.append(t * h[0])
        for k in range(1, DEGREE):
            h.append(t * h[k] - k * h[k - 1])
        return h

    def sums(batches):
        total = np.zeros(points * points)
        for batch in batches:
            cx, cy = ((batch.column(c).to_numpy() + 0.5) * BIN for c in ("i", "j"))
            m = batch.column("moments").flatten().to_numpy().reshape(-1, len(terms))
            for k in range(0, len(cx), 128):
                dx, dy = tx[:, None] - cx[None, k : k + 128], ty[:, None] - cy[None, k : k + 128]
                near = np.flatnonzero((dx * dx + dy * dy < REACH * REACH).any(0))
                if len(near):
                    h, g = hermite(dx[:, near]), hermite(dy[:, near])
                    total += sum((h[a] * g[b]) @ m[k : k + 128][near, t] for t, (a, b) in enumerate(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points * points)), pa.array(x), pa.array(y), pa.array(total)], names=["cell", "x", "y", "part"])

    peak = 1 / (2 * math.pi * l11 * l22 * s["n"])
    parts = bins.mapInArrow(sums, "cell long, x double, y double, part double")
    return parts.groupBy("cell").agg(F.first("x").alias("x"), F.first("y").alias("y"), (F.sum("part") * peak).alias("density"))


def kde_2d_error() -> float:
    """A bound of what ``kde_2d`` is off by, as a share of the kernel's peak: the series' rest from its degree on, and what lies beyond reach."""
    half = BIN / 2
    rest = sum(half**n * sum(1 / math.sqrt(math.factorial(k) * math.factorial(n - k)) for k in range(n + 1)) for n in range(DEGREE + 1, DEGREE + 40))
    return 1.2 * rest + math.exp(-((REACH - BIN) ** 2) / 2)  # 1.0865 squared bounds two Hermite functions


def _ranked(counts: DataFrame) -> DataFrame:
    """The Mann-Whitney figures of each variable, from variable, v, c (rows) and c1 (positives) of distinct values."""
    ranked = running(counts, "v", {"c": "upto"}, by=("variable",))
    before = F.col("upto") - F.col("c")
    s = ranked.groupBy("variable").agg(
        F.sum(F.col("c1") * (before + (F.col("c") + 1) / 2.0)).alias("r1"), F.sum("c1").alias("n1"), F.sum("c").alias("n"),
        F.sum(F.pow(F.col("c").cast("double"), 3.0) - F.col("c")).alias("ties")
    )
    n1, n0, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    spread = F.sqrt(n1 * n0 / 12.0 * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    s = s.select("variable", n1.alias("n1"), n0.alias("n0"), u.alias("u"), (n1 * n0 / 2.0).alias("mean"), spread.alias("sd"))
    z = F.when(F.col("sd") > 0, (F.greatest("u", 2 * F.col("mean") - F.col("u")) - F.col("mean") - 0.5) / F.col("sd"))
    r = F.when((F.col("n1") > 0) & (F.col("n0") > 0), 1 - 2 * F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0)))
    return s.select("variable", "n1", "n0", "u", z.alias("z"), r.alias("r")).withColumn("effect", effect_label(F.col("r")))


def _value_counts(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    long = long_form(df, columns, label).where(F.col("value").isNotNull())
    return long.groupBy("variable", F.col("value").alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col(label) == 1).alias("c1"))


def rank_test(df: DataFrame, column: str, label: str = "Presence") -> DataFrame:
    """OP-70, 71, 72: Mann-Whitney U of the positive class, two-sided by the normal approximation with ties and continuity.

    Columns n1, n0, u, z, r (rank-biserial, negative where positives are larger), effect. Ranks come from counts of distinct values.
    Without values there is no row.
    """
    return _ranked(_value_counts(df, [column], label)).drop("variable")


def two_sided_p(z: Column) -> Column:
    """The normal distribution's share beyond z on both sides: a power series up to 3 deviations (over root 2), a continued fraction beyond."""
    x = F.greatest(z, F.lit(0.0)) / math.sqrt(2)
    series = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1 + s * 2 * x * x / (2 * k + 1))
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * x * series
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / 2 / f)
    return F.least(F.lit(1.0), F.when(x < 3, near).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction))


def rank_tests(df: DataFrame, columns: list[str], label: str = "Presence", least: int = 10) -> DataFrame:
    """OP-72, 79: tests of several variables in one pass, with p and significance, by size of effect; classes below ``least`` rows are skipped."""
    tested = _ranked(_value_counts(df, columns, label)).where(
        (F.col("n1") >= least) & (F.col("n0") >= least)
    ).withColumn("p", two_sided_p(F.col("z")))
    return tested.withColumn("significance", stars(F.col("p"))).orderBy(F.desc(F.abs("r")))
