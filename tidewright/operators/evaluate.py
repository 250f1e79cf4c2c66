"""Evaluation of scores against labels (OP-63 to 66, 73 to 76, 94)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import decide
from .ordering import running
from .stats import rank_test, ratio


def temporal_split(df: DataFrame, share: float = 0.8, date: str = "Date", id_: str = "id", by_date: bool = False) -> DataFrame:
    """OP-73: ``is_train``, true for the first int(n * share) rows by date and then id.

    Rows are counted by date; only the date that the boundary falls into is ordered by id. ``by_date`` puts that whole
    date into the test part. NULL dates come first.
    """
    days = df.groupBy(date).agg(F.count("*").alias("c"))
    upto = running(days, date, {"c": "_upto"})
    upto = upto.crossJoin(F.broadcast(days.agg(F.sum("c").alias("_n"))))
    upto = upto.select(
        F.col(date).alias("_d"), (F.col("_upto") - F.col("c")).alias("_before"), "_upto", F.floor(F.col("_n") * share).cast("long").alias("_train")
    )
    at = df.join(upto, F.col(date).eqNullSafe(F.col("_d")))
    inside = at.where((F.col("_before") < F.col("_train")) & (F.col("_upto") > F.col("_train")))
    outside_ = at.where(
        ~((F.col("_before") < F.col("_train")) & (F.col("_upto") > F.col("_train")))
    ).withColumn("is_train", F.col("_upto") <= F.col("_train"))
    if by_date:
        inside = inside.withColumn("is_train", F.lit(False))
    else:
        inside = inside.withColumn("is_train", F.row_number().over(W.partitionBy("_d").orderBy(id_)) + F.col("_before") <= F.col("_train"))
    return outside_.unionByName(inside).drop("_d", "_before", "_upto", "_train")


def confusion(df: DataFrame, threshold: float | Column, score: str = "score", label: str = "label") -> DataFrame:
    """OP-63: tn, fp, fn, tp."""
    yes, true = decide(F.col(score), threshold) == 1, F.col(label) == 1
    return df.agg(
        F.count_if(~yes & ~true).alias("tn"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"),
        F.count_if(yes & true).alias("tp")
    )


def metrics(c: DataFrame) -> DataFrame:
    """OP-64, 65, 76: from a confusion matrix; quotients of nothing are 0."""
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select(
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), p.alias("precision"), r.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tn, tn + fp).alias("specificity"), ratio(tn, tn + fn).alias("npv"), ratio(fp, tn + fp).alias("fpr"), r.alias("tpr"),
    )


def classification_report(c: DataFrame) -> DataFrame:
    """OP-66: precision, recall, F1 and support of each class, their plain and weighted means, and accuracy."""
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    row = lambda name, t, f_pos, f_neg: F.struct(
        F.lit(name).alias("name"), ratio(t, t + f_pos).alias("precision"), ratio(t, t + f_neg).alias("recall"),
        ratio(2 * t, 2 * t + f_pos + f_neg).alias("f1"), (t + f_neg).alias("support")
    )
    two = c.select(row("0", tn, fn, fp).alias("a"), row("1", tp, fp, fn).alias("b"))
    n0, n1 = F.col("a.support"), F.col("b.support")
    mean = lambda x: (F.col(f"a.{x}") + F.col(f"b.{x}")) / 2
    heavy = lambda x: ratio(F.col(f"a.{x}") * n0 + F.col(f"b.{x}") * n1, n0 + n1)
    fold = lambda name, f: F.struct(
        F.lit(name).alias("name"), *[f(x).alias(x) for x in ("precision", "recall", "f1")], (n0 + n1).alias("support")
    )
    return two.select(F.inline(F.array("a", "b", fold("macro avg", mean), fold("weighted avg", heavy))))


def curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """OP-74, 75: for each distinct score as a threshold: tp, fp, fpr, tpr, precision, recall."""
    by_score = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("c1"), F.count_if(F.col(label) == 0).alias("c0")
    )
    down = by_score.withColumn("_key", -F.col("threshold"))
    counted = running(down, "_key", {"c1": "tp", "c0": "fp"})
    total = by_score.agg(F.sum("c1").alias("_p"), F.sum("c0").alias("_n"))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    return counted.crossJoin(F.broadcast(total)).select(
        "threshold", "tp", "fp", ratio(fp, F.col("_n")).alias("fpr"), ratio(tp, F.col("_p")).alias("tpr"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("_p")).alias("recall")
    )


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """OP-74: exact area under the ROC curve; NULL with one class only."""
    t = rank_test(df, score, label).agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"), F.max("u").alias("u"))  # one row, also without any score
    return t.select(F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auc"))


def choose_threshold(points: DataFrame, least_recall: float = 0.80) -> DataFrame:
    """OP-75: of the thresholds with enough recall the one of highest precision, the lowest of equals; else the nearest recall."""
    enough = F.col("recall") >= least_recall
    good = F.struct(
        enough.cast("int").alias("e"), F.when(enough, F.col("precision")).otherwise(-F.abs(F.col("recall") - least_recall)).alias("p"),
        (-F.col("threshold")).alias("t")
    )
    best = points.agg(F.max(F.struct(good.alias("g"), "threshold", "precision", "recall")).alias("b"))
    return best.select("b.threshold", "b.precision", "b.recall")
