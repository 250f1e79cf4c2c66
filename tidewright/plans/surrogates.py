"""Views that stand for observations and rasters over the star-schema test tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null
from ..schema import Axis

STEP, LAT0, LON0, COLUMNS = 0.05, 35.0, -75.0, 50
LON = Axis(LON0, STEP, COLUMNS)
VARIABLES = ["SST", "Chlorophyll", "Salinity", "Bathymetry"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str, items: DataFrame | None = None) -> DataFrame:
    """Observations: line items (or a stream of them)."""
    t = table(spark, sf, "lineitem") if items is None else items
    return nan_to_null(t.select(
        F.col("l_orderkey").alias("order"), F.col("l_shipdate").cast("timestamp").alias("Date"), (F.col("l_returnflag") == "R").cast("int").alias("Presence"), F.when(
            F.col("l_linenumber") != 7, F.col("l_quantity")
        ).alias("SST"),
        F.col("l_tax").alias("Chlorophyll"), F.col("l_discount").alias("Salinity"), (-F.col("l_extendedprice") / 100).alias("Bathymetry"), (F.col("l_quantity") > 40).alias("Is_Thermal_Front"),
    ))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A raster: parts as cells, 50 to a row."""
    t = table(spark, sf, "part")
    at = t.select(
        F.col("p_partkey").alias("cell_id"), F.floor(F.col("p_partkey") / COLUMNS).cast("int").alias("lat_idx"),
        (F.col("p_partkey") % COLUMNS).cast("int").alias("lon_idx"), F.col("p_size").cast("double").alias("value")
    )
    return at.withColumns({"lat": LAT0 + STEP * F.col("lat_idx"), "lon": LON0 + STEP * F.col("lon_idx"), "altitude": (F.col("value") - 25) * 10})


def lat_axis(spark: SparkSession, sf: str) -> Axis:
    return Axis(LAT0, STEP, table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] // COLUMNS + 1)


def pts(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Points in the raster's extent: orders (or a stream of them) at places mixed from their keys."""
    n = lat_axis(spark, sf).n
    orders = table(spark, sf, "orders") if orders is None else orders
    key = F.col("o_orderkey")
    y, x = (key * 48271 % 1000003) / 1000003.0, ((key * 69621 + 12345) % 1000003) / 1000003.0
    return orders.select(
        key.alias("id"), (LAT0 + y * (STEP * (n - 1))).alias("Lat"), (LON0 + x * (STEP * (COLUMNS - 1))).alias("Lon"),
        F.col("o_orderdate").cast("timestamp").alias("Date")
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and labels: events."""
    t = table(spark, sf, "events")
    return t.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("Date"), (F.col("value") / (1 + F.col("value"))).alias("score"),
        (F.col("event_type") == "error").cast("int").alias("label")
    )


OBS = """obs AS (SELECT l_orderkey AS "order", l_shipdate AS Date, CAST(l_returnflag = 'R' AS INT) AS Presence, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS SST, l_tax AS Chlorophyll, l_discount AS Salinity, -l_extendedprice / 100e0 AS Bathymetry, l_quantity > 40 AS Is_Thermal_Front FROM lineitem)"""
GRID = """grid AS (SELECT p_partkey AS cell_id, CAST(p_partkey // 50 AS INT) AS lat_idx, CAST(p_partkey % 50 AS INT) AS lon_idx, CAST(p_size AS DOUBLE) AS value, 35e0 + 0.05e0 * (p_partkey // 50) AS lat, -75e0 + 0.05e0 * (p_partkey % 50) AS lon, (p_size - 25e0) * 10 AS altitude FROM part)"""
PTS = """dims AS (SELECT max(p_partkey) // 50 + 1 AS n FROM part),
pts AS (SELECT o_orderkey AS id, 35e0 + CAST(o_orderkey * 48271 % 1000003 AS DOUBLE) / 1000003e0 * (0.05e0 * (n - 1)) AS Lat, -75e0 + CAST((o_orderkey * 69621 + 12345) % 1000003 AS DOUBLE) / 1000003e0 * (0.05e0 * 49) AS Lon, o_orderdate AS Date FROM orders, dims)"""
SCORED = """scored AS (SELECT event_id AS id, ts AS Date, value / (1 + value) AS score, CAST(event_type = 'error' AS INT) AS label FROM events)"""
