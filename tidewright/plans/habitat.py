"""The whole chain from raw sightings to scored points, as lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_key, flag_above, month_key, parse_date, patch
from ..operators import boosting, evaluate, knn, raster, sampling
from ..schema import FEATURE_ORDER, FRONT_THRESHOLD, SHELF_BAND, Axis, GridSpec
from ..sources.tables import scratch, stage

_POSITIVE = (1 << 63) - 1


def clean_sightings(raw: DataFrame) -> DataFrame:
    """OP-16, 17, 20, 84: id, Date, Lat, Lon, Presence of complete raw sightings.

    An id is a hash of 63 bits of the row and its number among equal rows, so that reruns and other partitions give the same ids.
    """
    named = raw.withColumnsRenamed({"SIGHTINGDATE": "Date", "LAT": "Lat", "LON": "Lon"}).dropna(subset=["Date", "Lat", "Lon"])
    parsed = named.select(parse_date(F.col("Date")).alias("Date"), "Lat", "Lon")
    counted = parsed.groupBy("Date", "Lat", "Lon").agg(F.count("*").alias("_n"))  # equal rows differ in their number alone
    each = counted.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return each.select(F.xxhash64("Date", "Lat", "Lon", "_k").bitwiseAND(_POSITIVE).alias("id"), "Date", "Lat", "Lon", F.lit(1).alias("Presence"))


def with_background(presences: DataFrame, altitude: DataFrame, lat: Axis, lon: Axis, **how) -> DataFrame:
    """OP-41, 77, 83: presences and their pseudo-absences, whose ids are hashes of 63 bits of (id, attempt)."""
    absences = sampling.pseudo_absences(presences, altitude, lat, lon, **how)
    own = absences.withColumn("id", F.xxhash64("id", "attempt").bitwiseAND(_POSITIVE)).drop("attempt")
    return sampling.with_absences(presences, own)


def sample(points: DataFrame, grid: DataFrame, spec: GridSpec, out: str) -> DataFrame:
    """OP-32 to 34: one variable at the points, by the method that its raster's description asks for."""
    return sample_all(points, [(spec, raster.Layer(out, grid, "nearest" if spec.nearest else "bilinear"))])


def sample_all(points: DataFrame, variables: list[tuple[GridSpec, raster.Layer]]) -> DataFrame:
    """OP-32 to 34, 39, 67: all variables at the points. Rasters of the same axes meet the points in one join; those with times where they are slices of one variable.

    Where there are several joins, what each but the last gives is written, so that the exchange that led to it is deleted before the next.
    """
    groups: dict[tuple, list[raster.Layer]] = {}
    for spec, layer in variables:
        groups.setdefault((spec.lat, spec.lon, spec.lon_360, spec.temporal, spec.variable if spec.temporal else None), []).append(layer)
    for k, ((lat, lon, lon_360, temporal, _), layers) in enumerate(groups.items()):
        p, on = points, ()
        if lon_360:
            p = p.withColumns({"_lon": F.col("Lon"), "Lon": F.pmod("Lon", F.lit(360.0))})
        if temporal:
            p = p.withColumn("_key", (day_key if temporal == "day" else month_key)(F.col("Date")))
            p, on = raster.nearest_time(p, layers[0].grid, "_key", "time", few=True).drop("_key"), ("time",)
        got = raster.sample_layers(p, layers, lat.ascending(), lon.ascending(), on).drop(*on)
        points = got.withColumn("Lon", F.col("_lon")).drop("_lon") if lon_360 else got
        if k < len(groups) - 1:
            points = stage(points, scratch(points.sparkSession, "group"), tidy=True)
    return points


def variables(points: DataFrame, sst: DataFrame, chlorophyll: DataFrame, patches: DataFrame, salinity: DataFrame, altitude: DataFrame, days: GridSpec, still: GridSpec) -> DataFrame:
    """OP-25 to 28, 32 to 34, 39, 67: the sampled features at the points: SST and its front by day, chlorophyll patched from a second raster, salinity, depth and slope."""
    out = sample_all(
        points, [
            (days, raster.Layer("SST", sst)), (days, raster.Layer("SST_Gradient", sst, "gradient")), (still, raster.Layer("Chlorophyll", chlorophyll)),
            (still, raster.Layer("_patch", patches)), (still, raster.Layer("Salinity", salinity, "bilinear")), (still, raster.Layer("Bathymetry", altitude)),
            (still, raster.Layer("Bathy_Slope", altitude, "gradient")),
        ]
    )
    return front(out.withColumn("Chlorophyll", patch(F.col("Chlorophyll"), F.col("_patch"))).drop("_patch"))


def with_distances(points: DataFrame, altitude: DataFrame, spec: GridSpec) -> DataFrame:
    """OP-25, 35, 36: distances to land and to the shelf break of points that were written."""
    cells = altitude.select((F.col("lat_idx").cast("long") * spec.lon.n + F.col("lon_idx")).alias("cell_id"), "lat", "lon", "value")
    return knn.nearest_cells(points, {"Dist_to_Shore_km": cells.where("value >= 0"), "Dist_to_Shelf_km": cells.where(F.col("value").between(*SHELF_BAND))})


def front(points: DataFrame) -> DataFrame:
    """OP-26: Is_Thermal_Front from SST_Gradient, which a point without SST doesn't have."""
    known = points.withColumn("SST_Gradient", F.when(F.col("SST").isNotNull(), F.col("SST_Gradient")))
    return known.withColumn("Is_Thermal_Front", flag_above(F.col("SST_Gradient"), FRONT_THRESHOLD))


def with_front(points: DataFrame, sst: DataFrame, spec: GridSpec) -> DataFrame:
    """OP-26, 67: SST_Gradient and Is_Thermal_Front of a table that has SST."""
    return front(sample_all(points, [(spec, raster.Layer("SST_Gradient", sst, "gradient"))]))


def patched(points: DataFrame, grid: DataFrame, spec: GridSpec, column: str) -> DataFrame:
    """OP-28, 39: fills missing values of a column from another raster."""
    return sample(points, grid, spec, "_new").withColumn(column, patch(F.col(column), F.col("_new"))).drop("_new")


def with_relief(points: DataFrame, altitude: DataFrame, spec: GridSpec) -> DataFrame:
    """OP-25, 35, 36, 67: slope, distance to land and to the shelf break, from one raster."""
    out = sample_all(points, [(spec, raster.Layer("Bathy_Slope", altitude, "gradient"))])
    return with_distances(stage(out, scratch(out.sparkSession, "relief"), tidy=True), altitude, spec)


def features(df: DataFrame) -> DataFrame:
    """OP-22, 27, 87: Month, the flag as a number, the features in their order."""
    return df.withColumns(
        {"Month": F.month("Date"), "Is_Thermal_Front": F.col("Is_Thermal_Front").cast("int")}
    ).select("id", "Date", "Lat", "Lon", "Presence", *FEATURE_ORDER)


def train_and_choose(df: DataFrame, trees: int = 500, depth: int = 6, least_recall: float = 0.80):
    """OP-73, 75, 100 to 103: the model, the scored test part and the chosen threshold (one row)."""
    split = evaluate.temporal_split(df)
    key = F.xxhash64("id") if "id" in df.columns else None
    model = boosting.fit_forest(split.where("is_train"), FEATURE_ORDER, how=boosting.Settings(trees=trees, depth=depth), key=key)
    scored = boosting.add_scores(model, split.where("NOT is_train"))
    return model, scored, evaluate.choose_threshold(evaluate.curve(scored, label="Presence"), least_recall)
