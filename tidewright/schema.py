"""Table schemas, the order of model features, plausible limits and raster descriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_D = T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: The columns of the tables that stages exchange.
SIGHTINGS = _struct(SIGHTINGDATE=T.StringType(), LAT=_D, LON=_D)
BASE = _struct(Date=T.TimestampType(), Lat=_D, Lon=_D, Presence=T.IntegerType(), SST=_D, Chlorophyll=_D, Salinity=_D, Bathymetry=_D)
ENGINEERED = T.StructType([*BASE.fields, T.StructField("SST_Gradient", _D), T.StructField("Is_Thermal_Front", T.BooleanType())])
FINAL = T.StructType([*ENGINEERED.fields, *_struct(Bathy_Slope=_D, Dist_to_Shore_km=_D, Dist_to_Shelf_km=_D, Month=T.IntegerType()).fields])
GRID = _struct(time=T.TimestampType(), depth_idx=T.IntegerType(), lat_idx=T.IntegerType(), lon_idx=T.IntegerType(), lat=_D, lon=_D, value=_D)

#: The features in the order that models take them.
FEATURE_ORDER = [
    "SST", "Chlorophyll", "Salinity", "Bathymetry", "SST_Gradient", "Is_Thermal_Front", "Month", "Bathy_Slope", "Dist_to_Shore_km", "Dist_to_Shelf_km"
]
#: Plausible limits of each variable (degrees C, mg/m3, PSU, m).
PLAUSIBLE = {"SST": (-2.0, 35.0), "Chlorophyll": (0.0, 100.0), "Salinity": (20.0, 40.0), "Bathymetry": (-11000.0, 100.0)}
#: Degrees C per km from which a gradient is a front.
FRONT_THRESHOLD = 0.035
#: The altitude band of shelf-break cells, m.
SHELF_BAND = (-250.0, -150.0)


@dataclass(frozen=True)
class Axis:
    """A regular axis: first coordinate, step (negative where it descends) and number of cells."""

    start: float
    step: float
    n: int

    def ascending(self) -> Axis:
        return self if self.step > 0 else Axis(self.start + self.step * (self.n - 1), -self.step, self.n)


@dataclass(frozen=True)
class GridSpec:
    """A raster: its variable, axes, temporal resolution (None, 'day' or 'month'), depth, longitude range and sampling."""

    variable: str
    lat: Axis
    lon: Axis
    temporal: str | None = None
    has_depth: bool = False
    lon_360: bool = False
    nearest: bool = True
