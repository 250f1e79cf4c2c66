"""Scalar expressions: missing values, flags, dates, labels (OP-20 to 31, 72, 84 to 87, 90 to 95)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: NaN in double or float columns becomes NULL."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def flag_above(value: Column, threshold: float) -> Column:
    """OP-26: value > threshold; missing (NULL or NaN) is false."""
    return F.coalesce(F.when(~F.isnan(value), value > threshold), F.lit(False))


def patch(old: Column, new: Column) -> Column:
    """OP-28: fills only where the old value is missing."""
    return F.coalesce(F.when(~F.isnan(old), old), F.when(~F.isnan(new), new))


def outside(value: Column, low: float, high: float) -> Column:
    """OP-31: below or above the limits; missing is not outside."""
    return F.coalesce((value < low) | (value > high), F.lit(False))


def parse_date(text: Column) -> Column:
    """OP-84: a date in one of several forms, day first. Two-digit years from 69 belong to the 1900s. NULL if none fits.

    The source it stands for raises on what it can't read; here such rows become NULL and can be counted.
    """
    t = F.trim(text)
    short = F.regexp_extract(t, r"^(\d{1,2})[-/ ]([A-Za-z]{3}|\d{1,2})[-/ ](\d{2})$", 3)
    century = F.when(short.cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
    full = F.when(short != "", F.concat(F.regexp_extract(t, r"^(.*[-/ ])\d{2}$", 1), century, short)).otherwise(t)
    month_name = F.concat(
        F.regexp_extract(full, r"^(\d{1,2}[-/ ])", 1), F.initcap(F.regexp_extract(full, r"^\d{1,2}[-/ ]([A-Za-z]{3})[-/ ]", 1)),
        F.regexp_extract(full, r"^\d{1,2}[-/ ][A-Za-z]{3}([-/ ].*)$", 1)
    )
    forms = [
        (month_name, "d-MMM-yyyy"), (month_name, "d MMM yyyy"), (full, "yyyy-MM-dd HH:mm:ss"), (full, "yyyy-MM-dd'T'HH:mm:ss"), (full, "yyyy-MM-dd"),
        (full, "d/M/yyyy"), (full, "d-M-yyyy"), (full, "d/M/yyyy H:mm")
    ]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for c, f in forms])


def day_key(date: Column) -> Column:
    """OP-85: the day at nine hours."""
    return F.date_trunc("day", date) + F.expr("INTERVAL 9 HOURS")


def month_key(date: Column) -> Column:
    """OP-86: the sixteenth of the month, at the same time of day."""
    return date + F.make_dt_interval(F.lit(16) - F.dayofmonth(date))


def decide(score: Column, threshold: Column | float) -> Column:
    """OP-94."""
    return F.when(score >= threshold, 1).otherwise(0)


def effect_label(r: Column) -> Column:
    """OP-72: the size of a rank-biserial correlation in words."""
    a = F.abs(r)
    return F.when(a >= 0.5, "large").when(a >= 0.3, "medium").when(a >= 0.1, "small").otherwise("negligible")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def odds_text(coefficient: Column) -> Column:
    """OP-93: the change of the odds for a unit, as text."""
    return F.format_string("%+.1f%%", (F.exp(coefficient) - 1) * 100)
