"""Models and what is read from them (OP-80, 93, 96 to 99, 104, 106 to 108); trees are in ``boosting``."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decide, odds_text
from ..sources.tables import scratch, stage
from .boosting import Forest, add_scores
from .ordering import quantiles


def fit_scaling(train: DataFrame, columns: list[str]) -> DataFrame:
    """OP-96, 97: one row with each column's exact median, and mean and population deviation after imputing it."""
    at = quantiles(train, columns, [0.5])
    med = stage(
        at.agg(*[F.max(F.when(F.col("variable") == c, F.col("at")[0])).alias(f"{c}_median") for c in columns]), scratch(train.sparkSession, "medians")
    )
    filled = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).crossJoin(F.broadcast(med))
    x = lambda c: F.coalesce(c, F.coalesce(f"{c}_median", F.lit(0.0)))
    return filled.agg(
        *[F.coalesce(F.first(f"{c}_median"), F.lit(0.0)).alias(f"{c}_median") for c in columns], *[F.avg(x(c)).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(x(c)).alias(f"{c}_sd") for c in columns]
    )


def scale(df: DataFrame, columns: list[str], fitted: DataFrame) -> DataFrame:
    """OP-96, 97: imputes and standardises; a constant column is divided by 1."""
    row = df.crossJoin(F.broadcast(fitted))
    done = {
        c: (
            F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median")) - F.col(f"{c}_mean")
        ) / F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0) for c in columns
    }
    return row.withColumns(done).drop(*fitted.columns)


def class_weights(train: DataFrame, label: str = "Presence") -> tuple[int, int]:
    n = train.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    return n[0], n[1]


def fit_logistic(train: DataFrame, columns: list[str], label: str = "Presence", c: float = 1.0, iterations: int = 1000):
    """OP-98: L2-penalised logistic regression with balanced classes; ``train`` is scaled.

    The penalty of the sum-form objective, 1 / c, becomes 1 / (c * sum of weights) here, and balanced weights sum to n.
    """
    n1, n0 = class_weights(train, label)
    n = n1 + n0
    weighed = train.withColumn("_w", F.when(F.col(label) == 1, n / (2.0 * max(n1, 1))).otherwise(n / (2.0 * max(n0, 1))))
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(weighed)
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="_w", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False,
        maxIter=iterations, tol=1e-9
    ).fit(x)


def odds(model, columns: list[str], spark: SparkSession) -> DataFrame:
    """OP-80, 93, 99: coefficient, odds ratio and its text for each feature, by size; the intercept is a row of its own."""
    rows = [(k, float(v)) for k, v in zip(columns, model.coefficients, strict=True)]
    table = spark.createDataFrame([*rows, ("(intercept)", float(model.intercept))], "feature string, coefficient double")
    return table.withColumns(
        {"odds_ratio": F.exp("coefficient"), "change": odds_text(F.col("coefficient"))}
    ).orderBy(F.desc(F.abs("coefficient")), "feature")


#: Made-up conditions to score, in FEATURE_ORDER.
SCENARIO_COLUMNS = "name string, SST double, Chlorophyll double, Salinity double, Bathymetry double, SST_Gradient double, Is_Thermal_Front double, Month int, Bathy_Slope double, Dist_to_Shore_km double, Dist_to_Shelf_km double"


def scenarios(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """OP-45: inline rows of features with a name."""
    return spark.createDataFrame(rows, SCENARIO_COLUMNS)


def score_scenarios(model: Forest, rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """OP-108: score and decision of each row at a stored threshold (one row)."""
    scored = add_scores(model, rows).crossJoin(F.broadcast(threshold))
    return scored.withColumn("decision", F.when(decide(F.col("score"), F.col("threshold")) == 1, "HIGH").otherwise("LOW"))


def kernel_pca(df: DataFrame, columns: list[str], gamma: float = 0.1, components: int = 2, most: int = 10_000, id_: str = "id") -> DataFrame:
    """OP-106: RBF kernel PCA of a bounded sample (``most`` rows, checked): id and pc1, pc2, ... The sign of a component is arbitrary.

    The kernel matrix grows with the square of the sample and is solved in one task, so that more rows are refused.
    """
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows; draw a sample of at most {most} first")
    names = [f"pc{i + 1}" for i in range(components)]

    def solve(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(id_)
        x = pdf[columns].to_numpy(float)
        square = (x * x).sum(1)
        k = np.exp(-gamma * np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
        k = k - k.mean(0)[None, :] - k.mean(1)[:, None] + k.mean()
        q = np.linalg.qr(k @ np.random.default_rng(0).normal(size=(len(k), min(len(k), components + 8))))[0]
        for _ in range(60):  # subspace iteration: only the leading components are wanted
            q = np.linalg.qr(k @ q)[0]
        values, small = np.linalg.eigh(q.T @ k @ q)
        order = np.argsort(values)[::-1][:components]
        z = q @ small[:, order] * np.sqrt(np.maximum(values[order], 0))
        z = np.pad(z, ((0, 0), (0, components - z.shape[1])))
        z *= np.where(z[np.abs(z).argmax(0), range(components)] < 0, -1, 1)
        return pd.DataFrame({id_: pdf[id_].to_numpy(), **{c: z[:, i] for i, c in enumerate(names)}})

    kind = df.schema[id_].dataType.simpleString()
    return df.select(id_, *columns, F.lit(0).alias("_g")).groupBy("_g").applyInPandas(
        lambda pdf: solve(pdf), f"{id_} {kind}, " + ", ".join(f"{c} double" for c in names)
    )


def separability(df: DataFrame, axes: tuple[str, str] = ("pc1", "pc2"), label: str = "Presence") -> DataFrame:
    """OP-107: distance of the class centroids over the mean of the classes' deviation of distances to their centroid."""
    a, b = axes
    centre = df.groupBy(label).agg(F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    spread = df.join(F.broadcast(centre), label).groupBy(label).agg(
        F.first("_a").alias("a"), F.first("_b").alias("b"),
        F.stddev_pop(F.sqrt(F.pow(F.col(a) - F.col("_a"), 2) + F.pow(F.col(b) - F.col("_b"), 2))).alias("s")
    )
    pick = lambda c, y: F.max(F.when(F.col(label) == y, F.col(c)))
    both = spread.agg(
        F.sqrt(F.pow(pick("a", 1) - pick("a", 0), 2) + F.pow(pick("b", 1) - pick("b", 0), 2)).alias("distance"), F.avg("s").alias("spread")
    )
    out = both.withColumn("separability", F.when(F.col("spread") > 0, F.col("distance") / F.col("spread")).otherwise(0.0))
    return out.withColumn("verdict", F.when(F.col("separability") > 1, "strong").when(F.col("separability") > 0.5, "moderate").otherwise("weak"))


