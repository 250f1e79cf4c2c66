"""Sampling and scoring of a stream of observations, and counts by day or month as they arrive.

Keys of day and month are tumbling windows with a labelled anchor; the stream forms add a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boosting import Forest, add_scores
from ..operators.raster import sample_nearest
from ..schema import Axis


def sample_stream(points: DataFrame, grid: DataFrame, lat: Axis, lon: Axis, out: str) -> DataFrame:
    """A stream-static join: nearest cell of a static raster for each arriving point."""
    return sample_nearest(points, grid, lat, lon, out)


def score_stream(model: Forest, points: DataFrame) -> DataFrame:
    return add_scores(model, points)


def counts_by_day(points: DataFrame, date: str = "Date", late: str = "2 days") -> DataFrame:
    """Observations and presences by day, labelled with the day at nine hours; rows later than ``late`` are left out."""
    w = F.window(date, "1 day")
    by = points.withWatermark(date, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("Presence") == 1).alias("n_presence"))
    return by.select((F.col("w.start") + F.expr("INTERVAL 9 HOURS")).alias("day"), "n", "n_presence")
