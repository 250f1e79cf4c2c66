"""The engine's queries over the surrogate views, each with its SQL where SQL can express it.

Every query reads whole tables. Floats are rounded in both forms, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..operators import evaluate, knn, raster, sampling, stats
from . import surrogates as S
from .surrogates import GRID, OBS, PTS, SCORED, VARIABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name, with its SQL over the given views."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ",\n".join(views) + "\n" if views else "") + sql
        return f

    return keep


def _r(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name or c)


def _text(date: str) -> Column:
    return F.date_format(date, "yyyy-MM-dd HH:mm:ss")


# ---- bins and rates ---------------------------------------------------------------------------------------------

_EDGES = """edges AS (SELECT list_sort(list_distinct(quantile_cont(SST, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM obs),
binned AS (SELECT o.*, CAST(greatest(len(list_filter(e, lambda x: x < SST)) - 1, 0) AS INT) AS bin FROM obs o, edges WHERE SST IS NOT NULL),
rates AS (SELECT bin, count(*) AS n, avg(Presence) AS rate FROM binned GROUP BY bin)"""


@query("SELECT bin, round(e[bin + 1], 6) AS lo, round(coalesce(e[bin + 2], e[-1]), 6) AS hi, round((e[bin + 1] + coalesce(e[bin + 2], e[-1])) / 2, 6) AS mid, printf('%.2f-%.2f', e[bin + 1], coalesce(e[bin + 2], e[-1])) AS label, n, round(rate, 6) AS rate FROM rates, edges", OBS, _EDGES)
def decile_presence_rate(spark, sf):
    """OP-18, 51, 68, 69."""
    return stats.binned_rate(S.obs(spark, sf), "SST", 10).select("bin", _r("lo"), _r("hi"), _r("mid"), "label", "n", _r("rate"))


@query("SELECT arg_max(bin, rate * 1e6 - bin) AS bin, round(max(rate), 6) AS rate FROM rates", OBS, _EDGES)
def peak_bin(spark, sf):
    """OP-55."""
    return stats.peak_bin(stats.binned_rate(S.obs(spark, sf), "SST", 10)).select("bin", _r("rate"))


@query("SELECT CAST(month(Date) AS INT) AS month, bin, count(*) AS n, round(avg(Presence), 6) AS rate FROM binned GROUP BY 1, 2", OBS, _EDGES)
def month_bin_rate(spark, sf):
    """OP-52, 87."""
    o = S.obs(spark, sf).withColumn("month", F.month("Date"))
    return stats.binned_rate(o, "SST", 10, by=("month",)).select("month", "bin", "n", _r("rate"))


@query("SELECT bin, count(*) AS n, round(avg(Presence), 6) AS rate FROM (SELECT Presence, CAST(greatest(len(list_filter(e, lambda x: x < d)) - 1, 0) AS INT) AS bin FROM (SELECT *, abs(Bathymetry) AS d FROM obs), (SELECT list_sort(list_distinct(quantile_cont(abs(Bathymetry), [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS e FROM obs)) GROUP BY bin", OBS)
def octile_depth_rate(spark, sf):
    """OP-68 of absolute depth."""
    return stats.binned_rate(S.obs(spark, sf).withColumn("depth", F.abs("Bathymetry")), "depth", 8).select("bin", "n", _r("rate"))


@query("SELECT CAST(year(Date) AS INT) AS year, CAST(month(Date) AS INT) AS month, count(*) AS n, round(avg(Presence), 6) AS rate FROM obs GROUP BY 1, 2", OBS)
def year_month_rate(spark, sf):
    """OP-52, 87."""
    return S.obs(spark, sf).groupBy(F.year("Date").alias("year"), F.month("Date").alias("month")).agg(
        F.count("*").alias("n"), _r(F.avg(F.col("Presence").cast("double")), "rate")
    )


@query("SELECT CAST(year(Date) AS INT) AS year, " + ", ".join(f"round(avg(CASE WHEN month(Date) = {m} THEN Presence END), 6) AS m{m}" for m in range(1, 13)) + " FROM obs GROUP BY 1", OBS)
def year_month_pivot(spark, sf):
    """OP-53."""
    o = S.obs(spark, sf).withColumns({"year": F.year("Date"), "month": F.month("Date")})
    p = stats.pivot_rates(o, "year", "month", list(range(1, 13)))
    return p.select("year", *[_r(F.col(str(m)), f"m{m}") for m in range(1, 13)])


@query("SELECT CAST(m.month AS INT) AS month, count(o.Date) AS n FROM (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN (SELECT * FROM obs WHERE Presence = 1) o ON month(o.Date) = m.month GROUP BY 1", OBS)
def month_counts(spark, sf):
    """OP-23, 54."""
    return stats.month_counts(S.obs(spark, sf).where("Presence = 1"))


@query("SELECT CAST(arg_max(month, n * 100 - month) AS INT) AS peak_month, max(n) AS peak_n, CAST(arg_min(month, n * 100 + month) AS INT) AS low_month, min(n) AS low_n FROM (SELECT month(Date) AS month, count(*) AS n FROM obs WHERE Presence = 1 GROUP BY 1)", OBS)
def month_extremes(spark, sf):
    """OP-55."""
    return stats.month_extremes(S.obs(spark, sf).where("Presence = 1"))


@query("SELECT strftime(min(Date), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(Date), '%Y-%m-%d %H:%M:%S') AS last FROM obs", OBS)
def date_range(spark, sf):
    """OP-56."""
    return S.obs(spark, sf).agg(F.min("Date").alias("a"), F.max("Date").alias("z")).select(_text("a").alias("first"), _text("z").alias("last"))


# ---- checks of a table ------------------------------------------------------------------------------------------

@query("SELECT n_presence, n_absence, round(n_absence / n_presence, 6) AS ratio, n_absence / n_presence BETWEEN 3.5 AND 4.5 AS ok FROM (SELECT count(*) FILTER (Presence = 1) AS n_presence, count(*) FILTER (Presence = 0) AS n_absence FROM obs)", OBS)
def class_balance(spark, sf):
    """OP-46."""
    return stats.class_balance(S.obs(spark, sf)).withColumn("ratio", F.round("ratio", 6))


_UNPIVOT = "long AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value, Presence FROM obs" for v in VARIABLES) + ")"
_LIMITS = "limits(variable, lo, hi) AS (VALUES ('SST', -2e0, 35e0), ('Chlorophyll', 0e0, 100e0), ('Salinity', 20e0, 40e0), ('Bathymetry', -11000e0, 100e0))"


@query("SELECT variable, count(value) AS valid, count(*) - count(value) AS missing, round(100.0 * count(value) / count(*), 6) AS pct, CASE WHEN 100.0 * count(value) / count(*) > 90 THEN 'ok' WHEN 100.0 * count(value) / count(*) > 50 THEN 'warn' ELSE 'bad' END AS status FROM long GROUP BY 1", OBS, _UNPIVOT)
def completeness(spark, sf):
    """OP-47, 92."""
    return stats.completeness(S.obs(spark, sf), VARIABLES).withColumn("pct", F.round("pct", 6))


@query("SELECT variable, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, count(*) FILTER (value < lo OR value > hi) AS outliers, min(value) >= any_value(lo) AND max(value) <= any_value(hi) AS in_range FROM long JOIN limits USING (variable) GROUP BY 1", OBS, _UNPIVOT, _LIMITS)
def plausibility(spark, sf):
    """OP-31, 48."""
    return stats.plausibility(S.obs(spark, sf)).withColumn("mean", F.round("mean", 4))


@query("SELECT variable, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean FROM long GROUP BY 1", OBS, _UNPIVOT)
def value_ranges(spark, sf):
    """OP-49."""
    return stats.summary(S.obs(spark, sf), VARIABLES).withColumn("mean", F.round("mean", 4))


@query("SELECT Presence, count(*) AS n, count(*) FILTER (coalesce(Salinity > 0.035, false)) AS fronts, sum(CAST(coalesce(SST > 25, false) AS INT))::BIGINT AS warm FROM obs GROUP BY 1", OBS)
def front_flags(spark, sf):
    """OP-26, 27."""
    o = S.obs(spark, sf)
    return o.groupBy("Presence").agg(
        F.count("*").alias("n"), F.count_if(scalars.flag_above(F.col("Salinity"), 0.035)).alias("fronts"),
        F.sum(scalars.flag_above(F.col("SST"), 25.0).cast("int")).alias("warm")
    )


@query("""SELECT measure, round(p, 6) AS pct_presence, round(a, 6) AS pct_absence, round(p / a, 6) AS factor FROM (
    SELECT measure, max(pct) FILTER (Presence = 1) AS p, max(pct) FILTER (Presence = 0) AS a FROM (
    SELECT Presence, 'depth' AS measure, 100.0 * count(*) FILTER (abs(Bathymetry) BETWEEN 50 AND 200) / count(Bathymetry) AS pct FROM obs GROUP BY 1 UNION ALL
    SELECT Presence, 'front', 100.0 * count(*) FILTER (Is_Thermal_Front) / count(*) FROM obs GROUP BY 1 UNION ALL
    SELECT Presence, 'both', 100.0 * count(*) FILTER (Is_Thermal_Front AND abs(Bathymetry) BETWEEN 50 AND 200) / count(*) FROM obs GROUP BY 1) GROUP BY 1)""", OBS)
def enrichment(spark, sf):
    """OP-57."""
    return stats.enrichment(S.obs(spark, sf)).select("measure", _r("pct_presence"), _r("pct_absence"), _r("factor"))


# ---- correlation, densities, rank tests -------------------------------------------------------------------------

_PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM obs" for i,
    a in enumerate(VARIABLES) for b in VARIABLES[i + 1 :]
) + ")"


@query("SELECT a, b, round(r, 6) AS r, n FROM pairs", OBS, _PAIRS)
def correlations(spark, sf):
    """OP-58."""
    return stats.correlations(S.obs(spark, sf), VARIABLES).withColumn("r", F.round("r", 6))


@query("SELECT a, b, round(r, 6) AS r, abs(r) > 0.5 AS high FROM pairs WHERE abs(r) > 0.3", OBS, _PAIRS)
def strong_correlations(spark, sf):
    """OP-59."""
    return stats.strong_correlations(stats.correlations(S.obs(spark, sf), VARIABLES)).select("a", "b", _r("r"), "high")


@query("""SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * (hi - lo) / 80, 3) AS lo, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * (hi - lo) / 80), 9) AS density FROM (SELECT unnest(range(80)) AS bin) b, (SELECT min(Bathymetry) AS lo, max(Bathymetry) AS hi, count(Bathymetry) AS total FROM obs)
    LEFT JOIN (SELECT least(floor((Bathymetry - lo) / ((hi - lo) / 80)), 79) AS bin, count(*) AS n FROM obs, (SELECT min(Bathymetry) AS lo, max(Bathymetry) AS hi FROM obs) GROUP BY 1) h ON h.bin = b.bin""", OBS)
def histogram(spark, sf):
    """OP-60."""
    return stats.histogram(S.obs(spark, sf), "Bathymetry").select("bin", _r("lo", digits=3), "n", _r("density", digits=9))


_KDE = """s AS (SELECT min(SST) AS lo, max(SST) AS hi, count(SST) AS total, stddev_samp(SST) * pow(count(SST), -0.2) AS h FROM obs)"""


@query("SELECT CAST(i AS INT) AS i, round(any_value(x), 6) AS x, round(sum(c * exp(-pow((x - v) / h, 2) / 2)) / (any_value(total) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM (SELECT SST AS v, count(*) AS c FROM obs WHERE SST IS NOT NULL GROUP BY 1), s, (SELECT unnest(range(100)) AS i), LATERAL (SELECT lo + (hi - lo) * i / 99 AS x) GROUP BY i", OBS, _KDE)
def kde(spark, sf):
    """OP-61."""
    return stats.kde(S.obs(spark, sf), "SST", 100).select("i", _r("x"), _r("density", digits=9))


_SAMPLE = "sample AS (SELECT score AS u, hour(Date)::DOUBLE AS v FROM scored)"
_SHAPE = """s AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, count(*) AS n, var_samp(u) * pow(count(*), -1 / 3e0) AS uu, var_samp(v) * pow(count(*), -1 / 3e0) AS vv, covar_samp(u, v) * pow(count(*), -1 / 3e0) AS uv FROM sample WHERE u IS NOT NULL AND v IS NOT NULL)"""


@query("""SELECT CAST(cell AS INT) AS cell, round(any_value(x), 6) AS x, round(any_value(y), 6) AS y, round(sum(exp(-(vv * (x - u) * (x - u) - 2 * uv * (x - u) * (y - v) + uu * (y - v) * (y - v)) / (uu * vv - uv * uv) / 2)) / (any_value(n) * 2 * pi() * sqrt(any_value(uu * vv - uv * uv))), 6) AS density FROM (
    SELECT *, u0 + (u1 - u0) * (cell // 20) / 19 AS x, v0 + (v1 - v0) * (cell % 20) / 19 AS y FROM sample, s, (SELECT unnest(range(400)) AS cell) WHERE u IS NOT NULL AND v IS NOT NULL) GROUP BY 1""", SCORED, _SAMPLE, _SHAPE)
def kde_2d(spark, sf):
    """OP-62: over all rows."""
    rows = S.scored(spark, sf).withColumn("hour", F.hour("Date").cast("double"))
    return stats.kde_2d(rows, "score", "hour").select(F.col("cell").cast("int").alias("cell"), _r("x"), _r("y"), _r("density"))


_RANKS = """ranks AS (SELECT variable, sum(c1 * (before + (c + 1) / 2)) - sum(c1) * (sum(c1) + 1) / 2 AS u, sum(c1) AS n1, sum(c) - sum(c1) AS n0, sum(c) AS n, sum(c::DOUBLE ** 3 - c) AS ties FROM (
    SELECT *, sum(c) OVER (PARTITION BY variable ORDER BY value) - c AS before FROM (SELECT variable, value, count(*) AS c, count(*) FILTER (Presence = 1) AS c1 FROM long WHERE value IS NOT NULL GROUP BY 1, 2)) GROUP BY 1),
tested AS (SELECT *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z, 1 - 2 * u / (n1 * n0) AS r FROM ranks)"""
# the share of a normal distribution beyond z on both sides: a series near 0, a continued fraction beyond
_P = """shares AS (SELECT *, CASE WHEN x < 3 THEN 1 - 2 / sqrt(pi()) * exp(-x * x) * x * list_reduce(list_reverse(range(1, 81)), lambda s, k: 1 + s * 2 * x * x / (2 * k + 1), 1e0)
    ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_reverse(range(1, 61)), lambda f, k: x + k / 2 / f, x) END AS p FROM (SELECT *, greatest(z, 0) / sqrt(2e0) AS x FROM tested))"""


@query("SELECT variable, n1::BIGINT AS n1, n0::BIGINT AS n0, round(u, 1) AS u, round(z, 5) AS z, round(r, 6) AS r, CASE WHEN abs(r) >= 0.5 THEN 'large' WHEN abs(r) >= 0.3 THEN 'medium' WHEN abs(r) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance FROM shares", OBS, _UNPIVOT, _RANKS, _P)
def rank_tests(spark, sf):
    """OP-70, 71, 72."""
    return stats.rank_tests(S.obs(spark, sf), VARIABLES).select(
        "variable", "n1", "n0", _r("u", digits=1), _r("z", digits=5), _r("r"), "effect", _r("p"), "significance"
    )


@query("SELECT variable, row_number() OVER (ORDER BY abs(round(r, 9)) DESC, variable) AS rank FROM tested", OBS, _UNPIVOT, _RANKS)
def effects_ranked(spark, sf):
    """OP-79, 80."""
    from pyspark.sql import Window as W

    t = stats.rank_tests(S.obs(spark, sf), VARIABLES)
    return t.select("variable", F.row_number().over(W.orderBy(F.desc(F.abs(F.round("r", 9))), "variable")).cast("long").alias("rank"))


# ---- evaluation -------------------------------------------------------------------------------------------------

_CONFUSION = "c AS (SELECT count(*) FILTER (NOT y AND label = 0) AS tn, count(*) FILTER (y AND label = 0) AS fp, count(*) FILTER (NOT y AND label = 1) AS fn, count(*) FILTER (y AND label = 1) AS tp FROM (SELECT *, score >= 0.98 AS y FROM scored))"


@query("SELECT * FROM c", SCORED, _CONFUSION)
def confusion(spark, sf):
    """OP-63, 94."""
    return evaluate.confusion(S.scored(spark, sf), 0.98)


@query("SELECT round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity, round(tn / (tn + fn), 6) AS npv, round(fp / (tn + fp), 6) AS fpr, round(tp / (tp + fn), 6) AS tpr FROM c", SCORED, _CONFUSION)
def metrics(spark, sf):
    """OP-64, 65, 76."""
    m = evaluate.metrics(evaluate.confusion(S.scored(spark, sf), 0.98))
    return m.select(*[_r(c) for c in m.columns])


@query("""SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s::DOUBLE AS support FROM (
    SELECT '0' AS name, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM c UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c UNION ALL
    SELECT 'macro avg', (tn / (tn + fn) + tp / (tp + fp)) / 2, (tn / (tn + fp) + tp / (tp + fn)) / 2, (2 * tn / (2 * tn + fn + fp) + 2 * tp / (2 * tp + fp + fn)) / 2, tn + fp + tp + fn FROM c UNION ALL
    SELECT 'weighted avg', (tn / (tn + fn) * (tn + fp) + tp / (tp + fp) * (tp + fn)) / (tn + fp + tp + fn), (tn + tp) / (tn + fp + tp + fn), (2 * tn / (2 * tn + fn + fp) * (tn + fp) + 2 * tp / (2 * tp + fp + fn) * (tp + fn)) / (tn + fp + tp + fn), tn + fp + tp + fn FROM c)""", SCORED, _CONFUSION)
def classification_report(spark, sf):
    """OP-66."""
    return evaluate.classification_report(evaluate.confusion(S.scored(spark, sf), 0.98)).select(
        "name", _r("precision"), _r("recall"), _r("f1"), "support"
    )


@query("SELECT id, rn <= n AS is_train FROM (SELECT id, row_number() OVER (ORDER BY Date, id) AS rn, CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS n FROM pts)", PTS)
def temporal_split(spark, sf):
    """OP-73."""
    return evaluate.temporal_split(S.pts(spark, sf)).select("id", "is_train")


_CURVE = """curve AS (SELECT score AS threshold, sum(c1) OVER w AS tp, sum(c0) OVER w AS fp, sum(c1) OVER () AS p, sum(c0) OVER () AS n FROM (SELECT score, count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 0) AS c0 FROM scored WHERE score IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"""


@query("SELECT round(threshold, 9) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM curve", SCORED, _CURVE)
def roc_curve(spark, sf):
    """OP-74."""
    return evaluate.curve(S.scored(spark, sf)).select(_r("threshold", digits=9), "tp", "fp", _r("fpr"), _r("tpr"))


@query("SELECT round(threshold, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM curve", SCORED, _CURVE)
def pr_curve(spark, sf):
    """OP-75."""
    return evaluate.curve(S.scored(spark, sf)).select(_r("threshold", digits=9), _r("precision"), _r("recall"))


@query("SELECT round(threshold, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM curve WHERE tp / p >= 0.8 ORDER BY tp / (tp + fp) DESC, threshold LIMIT 1", SCORED, _CURVE)
def chosen_threshold(spark, sf):
    """OP-75."""
    return evaluate.choose_threshold(evaluate.curve(S.scored(spark, sf))).select(_r("threshold", digits=9), _r("precision"), _r("recall"))


@query("SELECT round((sum(c1 * (before + (c + 1) / 2)) - sum(c1) * (sum(c1) + 1) / 2) / (sum(c1) * (sum(c) - sum(c1))), 9) AS auc FROM (SELECT *, sum(c) OVER (ORDER BY score) - c AS before FROM (SELECT score, count(*) AS c, count(*) FILTER (label = 1) AS c1 FROM scored WHERE score IS NOT NULL GROUP BY 1))", SCORED)
def auc(spark, sf):
    """OP-74."""
    return evaluate.auc(S.scored(spark, sf)).select(_r("auc", digits=9))


@query("SELECT count(*) FILTER (d = 'HIGH') AS high, count(*) FILTER (d = 'LOW') AS low FROM (SELECT CASE WHEN score >= 0.95 THEN 'HIGH' ELSE 'LOW' END AS d FROM scored)", SCORED)
def decisions(spark, sf):
    """OP-94."""
    yes = scalars.decide(F.col("score"), 0.95)
    return S.scored(spark, sf).agg(F.count_if(yes == 1).alias("high"), F.count_if(yes == 0).alias("low"))


# ---- rows and columns -------------------------------------------------------------------------------------------

@query("SELECT id, strftime(Date, '%Y-%m-%d %H:%M:%S') AS Date, round(Lat, 6) AS Lat, round(Lon, 6) AS Lon, 1 AS Presence FROM pts WHERE Date IS NOT NULL AND Lat IS NOT NULL AND Lon IS NOT NULL", PTS)
def renamed_complete(spark, sf):
    """OP-16, 17, 20."""
    raw = S.pts(spark, sf).withColumnsRenamed({"Date": "SIGHTINGDATE", "Lat": "LAT", "Lon": "LON"})
    named = raw.withColumnsRenamed({"SIGHTINGDATE": "Date", "LAT": "Lat", "LON": "Lon"}).dropna(subset=["Date", "Lat", "Lon"])
    return named.select("id", _text("Date").alias("Date"), _r("Lat"), _r("Lon"), F.lit(1).alias("Presence"))


@query("SELECT count(*) AS complete, count(SST) AS with_sst, (SELECT count(*) FROM obs) AS n FROM obs WHERE SST IS NOT NULL AND Salinity IS NOT NULL", OBS)
def complete_rows(spark, sf):
    """OP-18, 19."""
    o = S.obs(spark, sf)
    return o.select("SST", "Salinity").dropna("any").agg(
        F.count("*").alias("complete"), F.count("SST").alias("with_sst")
    ).crossJoin(F.broadcast(o.agg(F.count("*").alias("n"))))


@query("SELECT Presence, SST, Bathymetry FROM obs WHERE Presence = 1 AND SST IS NOT NULL AND Bathymetry IS NOT NULL AND abs(Bathymetry) < 1000 AND Salinity < 0.03", OBS)
def compound_filter(spark, sf):
    """OP-21, 22, 23, 24: columns that don't exist are left out."""
    o = S.obs(spark, sf)
    used = o.where(
        (F.col("Presence") == 1) & F.col("SST").isNotNull() & F.col("Bathymetry").isNotNull() & (F.abs("Bathymetry") < 1000) & (F.col("Salinity") < 0.03)
    )
    return used.select([c for c in ("Presence", "SST", "Bathymetry", "Depth_Class") if c in o.columns])


@query("SELECT count(*) FILTER (abs(Bathymetry) BETWEEN 50 AND 200) AS band, (SELECT count(*) FROM grid WHERE altitude BETWEEN -250 AND -150) AS shelf, (SELECT count(*) FROM grid WHERE altitude >= 0) AS land FROM obs", OBS, GRID)
def range_predicates(spark, sf):
    """OP-25."""
    g = S.grid(spark, sf).agg(F.count_if(F.col("altitude").between(-250, -150)).alias("shelf"), F.count_if(F.col("altitude") >= 0).alias("land"))
    return S.obs(spark, sf).agg(F.count_if(F.abs("Bathymetry").between(50, 200)).alias("band")).crossJoin(F.broadcast(g))


@query('SELECT "order", count(*) AS n, round(sum(coalesce(SST, Chlorophyll * 100)), 4) AS patched FROM obs GROUP BY 1', OBS)
def patched_values(spark, sf):
    """OP-28, 29, 39."""
    o = S.obs(spark, sf).withColumn("SST", scalars.patch(F.col("SST"), F.col("Chlorophyll") * 100))
    return o.groupBy("order").agg(F.count("*").alias("n"), _r(F.sum("SST"), "patched", 4))


@query("SELECT count(*) AS n, count(extra) AS with_extra, count(SST) AS with_sst FROM (SELECT SST, NULL AS extra FROM obs UNION ALL SELECT NULL, score FROM scored)", OBS, SCORED)
def union_by_name(spark, sf):
    """OP-83."""
    a, b = S.obs(spark, sf).select("SST"), S.scored(spark, sf).select(F.col("score").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True).agg(
        F.count("*").alias("n"), F.count("extra").alias("with_extra"), F.count("SST").alias("with_sst")
    )


@query("SELECT row_number() OVER (ORDER BY Date, label DESC, id) AS obs_id, id FROM scored", SCORED)
def sorted_ids(spark, sf):
    """OP-77, 78: rows numbered in order of date, positives first; offsets of blocks replace one global window."""
    s = S.scored(spark, sf)
    day = F.to_date("Date")
    from pyspark.sql import Window as W

    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    offsets = s.groupBy(day.alias("day")).agg(F.count("*").alias("c")).select("day", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("day").orderBy("Date", F.desc("label"), "id")
    return s.withColumn("day", day).join(F.broadcast(offsets), "day").select((F.row_number().over(inside) + F.col("offset")).alias("obs_id"), "id")


@query(f"SELECT id FROM pts ORDER BY {sampling.uniform_sql('id', '0', 42)}, id LIMIT 1000", PTS)
def fixed_sample(spark, sf):
    """OP-81: the limit is the operator."""
    return sampling.fixed_sample(S.pts(spark, sf), 1000).select("id")


@query("SELECT p_partkey AS id, lower(p_type) AS low, trim(p_name) AS name, split_part(p_brand, '#', 2) AS brand, starts_with(p_type, 'ECO') AS eco, printf('%.2f', CAST(p_size AS DOUBLE)) AS size FROM part")
def text_functions(spark, sf):
    """OP-95."""
    p = S.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.lower("p_type").alias("low"), F.trim("p_name").alias("name"), F.split("p_brand", "#")[1].alias("brand"),
        F.startswith("p_type", F.lit("ECO")).alias("eco"), F.format_string("%.2f", F.col("p_size").cast("double")).alias("size")
    )


@query("SELECT id, printf('%+.1f%%', (exp(score) - 1) * 100) AS change, round(exp(score), 6) AS odds FROM scored", SCORED)
def odds_text(spark, sf):
    """OP-93."""
    return S.scored(spark, sf).select("id", scalars.odds_text(F.col("score")).alias("change"), _r(F.exp("score"), "odds"))


# ---- dates ------------------------------------------------------------------------------------------------------

@query("SELECT id, strftime(date_trunc('day', Date) + INTERVAL 9 HOURS, '%Y-%m-%d %H:%M:%S') AS day, strftime(Date + (16 - day(Date)) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS month, CAST(month(Date) AS INT) AS m, CAST(year(Date) AS INT) AS y FROM scored", SCORED)
def temporal_keys(spark, sf):
    """OP-85, 86, 87."""
    return S.scored(spark, sf).select(
        "id", _text(scalars.day_key(F.col("Date"))).alias("day"), _text(scalars.month_key(F.col("Date"))).alias("month"), F.month("Date").alias("m"),
        F.year("Date").alias("y")
    )


@query("SELECT id, strftime(Date, '%Y-%m-%d') AS parsed FROM pts", PTS)
def mixed_dates(spark, sf):
    """OP-84: dates written in four forms are read back."""
    forms = F.when(F.col("id") % 4 == 0, F.date_format("Date", "d-MMM-yy")).when(
        F.col("id") % 4 == 1, F.date_format("Date", "yyyy-MM-dd")
    ).when(F.col("id") % 4 == 2, F.date_format("Date", "dd/MM/yyyy")).otherwise(F.upper(F.date_format("Date", "dd-MMM-yyyy")))
    return S.pts(spark, sf).select("id", F.date_format(scalars.parse_date(forms), "yyyy-MM-dd").alias("parsed"))


@query("""SELECT id, strftime(coalesce(CASE WHEN below IS NULL OR (above IS NOT NULL AND epoch_us(above) - epoch_us(Date) <= epoch_us(Date) - epoch_us(below)) THEN above ELSE below END), '%Y-%m-%d %H:%M:%S') AS time FROM (
    SELECT id, Date, (SELECT max(t) FROM axis WHERE t <= Date) AS below, (SELECT min(t) FROM axis WHERE t >= Date) AS above FROM scored)""", SCORED, "axis AS (SELECT DISTINCT date_trunc('day', Date) + INTERVAL 9 HOURS AS t FROM scored WHERE day(Date) % 2 = 0)")
def nearest_time(spark, sf):
    """OP-32, 38."""
    s = S.scored(spark, sf)
    axis = s.where(F.day("Date") % 2 == 0).select(scalars.day_key(F.col("Date")).alias("time")).distinct()
    return raster.nearest_time(s, axis, "Date", "time").select("id", _text("time").alias("time"))


# ---- rasters ----------------------------------------------------------------------------------------------------

_NEAR = """near AS (SELECT pts.*, CAST(greatest(0, least(n - 1, floor((Lat - 35e0) / 0.05e0 + 0.5e0))) AS INT) AS i, CAST(greatest(0, least(49, floor((Lon + 75e0) / 0.05e0 + 0.5e0))) AS INT) AS j FROM pts, dims)"""


@query("SELECT id, value FROM near LEFT JOIN grid ON lat_idx = i AND lon_idx = j", GRID, PTS, _NEAR)
def nearest_cell(spark, sf):
    """OP-33."""
    return raster.sample_nearest(S.pts(spark, sf), S.grid(spark, sf), S.lat_axis(spark, sf), S.LON, "value").select("id", "value")


@query("""SELECT id, round(sum(value * (CASE WHEN a = 1 THEN y - i ELSE 1 - (y - i) END) * (CASE WHEN b = 1 THEN x - j ELSE 1 - (x - j) END)), 5) AS value FROM (
    SELECT id, y, x, least(floor(y), n - 2) AS i, least(floor(x), 48) AS j FROM (SELECT id, (Lat - 35e0) / 0.05e0 AS y, (Lon + 75e0) / 0.05e0 AS x, n FROM pts, dims) WHERE y BETWEEN 0 AND n - 1 AND x BETWEEN 0 AND 49) p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)
    JOIN grid ON lat_idx = i + a AND lon_idx = j + b GROUP BY id HAVING count(value) = 4""", GRID, PTS)
def bilinear(spark, sf):
    """OP-34."""
    out = raster.sample_bilinear(S.pts(spark, sf), S.grid(spark, sf), S.lat_axis(spark, sf), S.LON, "value")
    return out.select("id", _r("value", digits=5)).where("value IS NOT NULL")


_GRADIENT = """d AS (SELECT *, CASE WHEN ln IS NULL AND lp IS NULL THEN NULL WHEN lp IS NULL THEN vn - value WHEN ln IS NULL THEN value - vp ELSE (vn - vp) / 2 END AS dy, CASE WHEN on_ IS NULL AND op IS NULL THEN NULL WHEN op IS NULL THEN wn - value WHEN on_ IS NULL THEN value - wp ELSE (wn - wp) / 2 END AS dx FROM (
    SELECT *, lead(lat_idx) OVER a AS ln, lag(lat_idx) OVER a AS lp, lead(value) OVER a AS vn, lag(value) OVER a AS vp, lead(lon_idx) OVER o AS on_, lag(lon_idx) OVER o AS op, lead(value) OVER o AS wn, lag(value) OVER o AS wp FROM grid WINDOW a AS (PARTITION BY lon_idx ORDER BY lat_idx), o AS (PARTITION BY lat_idx ORDER BY lon_idx))),
g AS (SELECT cell_id, lat_idx, lon_idx, sqrt(pow(dy / (111.32e0 * 0.05e0), 2) + pow(dx / (111.32e0 * 0.05e0 * cos(radians((SELECT avg(lat) FROM grid)))), 2)) AS gradient FROM d)"""


@query("SELECT cell_id, round(gradient, 5) AS gradient FROM g", GRID, _GRADIENT)
def gradient(spark, sf):
    """OP-67, 91."""
    return raster.gradient(S.grid(spark, sf), S.STEP, S.STEP).select("cell_id", _r("gradient", digits=5))


@query("SELECT id, round(gradient, 5) AS gradient, coalesce(gradient > 1.5, false) AS front FROM near LEFT JOIN g ON lat_idx = i AND lon_idx = j", GRID, PTS, _NEAR, _GRADIENT)
def fronts_at_points(spark, sf):
    """OP-26, 33, 67 composed."""
    g = raster.gradient(S.grid(spark, sf), S.STEP, S.STEP).drop("value").withColumnRenamed("gradient", "value")
    at = raster.sample_nearest(S.pts(spark, sf), g, S.lat_axis(spark, sf), S.LON, "gradient")
    return at.select("id", _r("gradient", digits=5), scalars.flag_above(F.col("gradient"), 1.5).alias("front"))


@query("SELECT CAST(year(Date) AS INT) AS year, round(min(Lat) - 0.5, 6) AS lat_min, round(max(Lat) + 0.5, 6) AS lat_max, round(min(Lon) - 0.5, 6) AS lon_min, round(max(Lon) + 0.5, 6) AS lon_max FROM pts GROUP BY 1", PTS)
def bounding_boxes(spark, sf):
    """OP-37, 50."""
    b = raster.bounding_box(S.pts(spark, sf).withColumn("year", F.year("Date")), 0.5, ("year",))
    return b.select("year", *[_r(c) for c in b.columns[1:]])


@query("SELECT cell_id FROM grid, (SELECT min(Lat) + 0.2 AS a, max(Lat) - 0.2 AS b, min(Lon) + 0.2 AS c, max(Lon) - 0.2 AS d FROM pts) WHERE lat BETWEEN a AND b AND lon BETWEEN c AND d", GRID, PTS)
def cells_in_box(spark, sf):
    """OP-04, 37."""
    return raster.within_box(S.grid(spark, sf), raster.bounding_box(S.pts(spark, sf), -0.2)).select("cell_id")


@query("SELECT a.lat_idx, b.lon_idx FROM (SELECT DISTINCT lat_idx FROM grid) a, (SELECT DISTINCT lon_idx FROM grid) b", GRID)
def mesh(spark, sf):
    """OP-44."""
    g = S.grid(spark, sf)
    return raster.mesh(g.select("lat_idx").distinct(), g.select("lon_idx").distinct())


@query("SELECT id FROM near JOIN grid ON lat_idx = i AND lon_idx = j WHERE altitude < 0", GRID, PTS, _NEAR)
def ocean_points(spark, sf):
    """OP-30."""
    g = S.grid(spark, sf).drop("value").withColumnRenamed("altitude", "value")
    return raster.is_ocean(S.pts(spark, sf), g, S.lat_axis(spark, sf), S.LON).select("id")


@query("SELECT cell_id, round(value, 6) AS value FROM grid WHERE lat BETWEEN 35.1 AND 36.1 AND lon BETWEEN -74.5 AND -73.5 AND lat_idx % 2 = 0", GRID)
def slab_scan(spark, sf):
    """OP-04, 05: range predicates, and one slice of a depth axis."""
    from ..sources.cubes import depth_slice, slab

    g = S.grid(spark, sf).withColumn("depth_idx", F.col("lat_idx") % 2)
    return depth_slice(slab(g, (35.1, 36.1), (-74.5, -73.5))).select("cell_id", _r("value"))


_KNN = """best AS (SELECT id, any_value(p.Lat) AS Lat, any_value(p.Lon) AS Lon, arg_min({{'a': c.lat, 'o': c.lon}}, pow(p.Lat * 111.32e0 - c.lat * 111.32e0, 2) + pow((p.Lon - c.lon) * 111.32e0 * cos(radians(m)), 2)) AS w FROM pts p, (SELECT avg(Lat) AS m FROM pts), (SELECT * FROM grid WHERE {0}) c GROUP BY id)"""
_HAVERSINE = "round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(w.a - Lat) / 2), 2) + cos(radians(Lat)) * cos(radians(w.a)) * pow(sin(radians(w.o - Lon) / 2), 2)))), 4)"


@query(f"SELECT id, {_HAVERSINE} AS km FROM best", GRID, PTS, _KNN.format("altitude >= 0"))
def shore_distance(spark, sf):
    """OP-35, 88."""
    return knn.nearest_cell(S.pts(spark, sf), S.grid(spark, sf).where("altitude >= 0"), "km").select("id", _r("km", digits=4))


@query(f"SELECT id, {_HAVERSINE} AS km FROM best", GRID, PTS, _KNN.format("altitude BETWEEN -250 AND -150"))
def shelf_distance(spark, sf):
    """OP-36."""
    return knn.nearest_cell(S.pts(spark, sf), S.grid(spark, sf).where("altitude BETWEEN -250 AND -150"), "km").select("id", _r("km", digits=4))


@query("SELECT id, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(40 - Lat) / 2), 2) + cos(radians(Lat)) * cos(radians(40)) * pow(sin(radians(-70 - Lon) / 2), 2)))), 4) AS km, round(111.32e0 * 0.05e0 * cos(radians(Lat)), 6) AS width, round(Lat, 5) AS lat5 FROM pts", PTS)
def distances(spark, sf):
    """OP-88, 89, 90, 91."""
    lat, lon = F.col("Lat"), F.col("Lon")
    return S.pts(spark, sf).select(
        "id", _r(geo.haversine_km(lat, lon, F.lit(40.0), F.lit(-70.0)), "km", 4), _r(geo.pixel_km(0.05, 0.05, lat)[1], "width"), _r("Lat", "lat5", 5)
    )


@query("SELECT id, round(greatest(-90, least(90, Lat * 3)), 6) AS lat, round(((Lon * 5 + 180) % 360 + 360) % 360 - 180, 6) AS lon, round((Lon % 360 + 360) % 360, 6) AS lon360 FROM pts", PTS)
def wrapped(spark, sf):
    """OP-42, 43."""
    return S.pts(spark, sf).select(
        "id", _r(geo.clamp_lat(F.col("Lat") * 3), "lat"), _r(geo.wrap_lon(F.col("Lon") * 5), "lon"), _r(geo.lon_360(F.col("Lon")), "lon360")
    )


# ---- generated points -------------------------------------------------------------------------------------------

_RING = f"""tried AS (SELECT id, Lat, Lon, k AS attempt, sqrt({sampling.uniform_sql('id', 'k', 42)} * (900e0 - 25e0) + 25e0) / 6371e0 AS d, {sampling.uniform_sql('id', 'k', 43)} * 2 * pi() AS b, radians(Lat) AS a FROM pts, (SELECT unnest(range({{n}}))::BIGINT AS k)),
ring AS (SELECT id, attempt, Lat AS lat0, Lon AS lon0, round(degrees(asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b))), 5) AS Lat, round(((Lon + degrees(atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * (sin(a) * cos(d) + cos(a) * sin(d) * cos(b)))) + 180) % 360 + 360) % 360 - 180, 5) AS Lon FROM tried)"""


@query("SELECT id, attempt, Lat AS lat, Lon AS lon FROM ring", PTS, _RING.format(n=3))
def ring_points(spark, sf):
    """OP-40, 41, 42, 90."""
    return sampling.ring_points(S.pts(spark, sf), range(3), 5.0, 30.0).select("id", "attempt", F.col("Lat").alias("lat"), F.col("Lon").alias("lon"))


@query("""SELECT id, attempt FROM (SELECT id, attempt, row_number() OVER (PARTITION BY id ORDER BY attempt) AS n FROM (SELECT ring.*, CAST(greatest(0, least(n - 1, floor((Lat - 35e0) / 0.05e0 + 0.5e0))) AS INT) AS i, CAST(greatest(0, least(49, floor((Lon + 75e0) / 0.05e0 + 0.5e0))) AS INT) AS j FROM ring, dims) r JOIN grid ON lat_idx = i AND lon_idx = j WHERE altitude < 0) WHERE n <= 4""", GRID, PTS, _RING.format(n=24))
def pseudo_absences(spark, sf):
    """OP-30, 40, 41."""
    g = S.grid(spark, sf).drop("value").withColumnRenamed("altitude", "value")
    return sampling.pseudo_absences(
        S.pts(spark, sf), g, S.lat_axis(spark, sf), S.LON, attempts=24, inner_km=5.0, outer_km=30.0
    ).select("id", "attempt")
