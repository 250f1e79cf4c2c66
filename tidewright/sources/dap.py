"""An opener of rasters behind an OPeNDAP (DAP 2) server, for ``read_cube`` (OP-03b, 04, 06).

Axes are asked for first, then only the part of the variable that the box holds, by a constraint in the request's URL.
A key is ``url|variable|time index|depth index``; the last two may be empty where the variable has no such dimension.
"""

from __future__ import annotations

import datetime
import math
import re
import struct
import urllib.request

import numpy as np

from .cubes import Plane

#: How the protocol codes types on the wire.
WIRE = {"Byte": ">u4", "Int16": ">i4", "UInt16": ">u4", "Int32": ">i4", "UInt32": ">u4", "Float32": ">f4", "Float64": ">f8"}
#: Names by which servers call the axes.
AXES = {"time": ("time", "t"), "depth": ("depth", "altitude", "zlev", "level"), "lat": ("lat", "latitude", "y"), "lon": ("lon", "longitude", "x")}
_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
TIMEOUT_S = 60


def _get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT_S) as r:
        return r.read()


def declared(dds: str, variable: str) -> list[tuple[str, int]]:
    """The dimensions (name, size) of a variable, from a dataset descriptor."""
    m = re.search(rf"\b(?:{'|'.join(WIRE)})\s+{re.escape(variable)}((?:\s*\[[^\]]*\])+)\s*;", dds)
    if not m:
        raise OSError(f"no variable {variable}")
    return [(n, int(k)) for n, k in re.findall(r"\[\s*(\w+)\s*=\s*(\d+)\s*\]", m[1])]


def decode(body: bytes) -> dict[str, np.ndarray]:
    """The arrays of a data response, by name."""
    dds, _, data = body.partition(b"\nData:\n")
    out, at = {}, 0
    for kind, name, dims in re.findall(rf"\b({'|'.join(WIRE)})\s+(\w+)((?:\s*\[[^\]]*\])*)\s*;", dds.decode()):
        shape = [int(k) for k in re.findall(r"=\s*(\d+)\s*\]", dims)]
        n = 1
        if shape:
            n, again = struct.unpack_from(">II", data, at)
            if n != again or n != math.prod(shape):
                raise OSError(f"{name}: a length that does not fit its shape")
            at += 8
        wire = np.dtype("u1" if kind == "Byte" and shape else WIRE[kind])
        out[name] = np.frombuffer(data, wire, n, at).astype(float).reshape(shape)
        at += -(-n * wire.itemsize // 4) * 4
    return out


def _attributes(das: str, name: str) -> dict[str, str]:
    block = re.search(rf"\b{re.escape(name)}\s*\{{([^}}]*)\}}", das)
    return {k: v.strip().strip('"') for k, v in re.findall(r"\w+\s+(\w+)\s+([^;]*);", block[1])} if block else {}


def inside(axis: np.ndarray, bounds: tuple[float, float]) -> tuple[int, int] | None:
    at = np.flatnonzero((axis >= bounds[0]) & (axis <= bounds[1]))
    return (int(at[0]), int(at[-1])) if len(at) else None


def numbers(axis: np.ndarray) -> np.ndarray:
    """The number of each coordinate, counted from the least."""
    n = np.arange(len(axis))
    return n if len(axis) < 2 or axis[0] < axis[-1] else n[::-1]


def moment(value: float, units: str) -> datetime.datetime:
    m = re.match(r"(\w+) since (\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{2}):(\d{2}):(\d{2}))?", units)
    if not m:
        raise OSError(f"time units not understood: {units}")
    y, mo, d = map(int, m[2].split("-"))
    return datetime.datetime(y, mo, d, *(int(x or 0) for x in m.groups()[2:])) + datetime.timedelta(seconds=value * _SECONDS[m[1]])


def open_slab(key: str, box: dict[str, tuple[float, float]]) -> list[Plane]:
    """The plane of one time and depth inside the box. Fill values and NaN are missing.

    Indices count from the lesser coordinate, also where the server's axis descends.
    """
    url, variable, time_index, depth_index = (key.split("|") + ["", ""])[:4]
    dims = declared(_get(f"{url}.dds").decode(), variable)
    das = _get(f"{url}.das").decode()
    role = {name: r for r, names in AXES.items() for name, _ in dims if name.lower() in names}
    axes = decode(_get(f"{url}.dods?{','.join(n for n, _ in dims)}"))
    picked, spans = [], {}
    for name, size in dims:
        r = role.get(name)
        if r in ("lat", "lon"):
            span = inside(axes[name], box.get(r, (-math.inf, math.inf)))
            if span is None:
                return []
            spans[r] = (name, *span)
        else:
            at = int((time_index if r == "time" else depth_index) or 0)
            if not 0 <= at < size:
                raise OSError(f"{name} has no index {at}")
            span = (at, at)
            spans[r or name] = (name, *span)
        picked.append("[%d:1:%d]" % span)
    values = decode(_get(f"{url}.dods?{variable}{''.join(picked)}"))[variable]
    order = [role.get(n) for n, _ in dims if role.get(n) in ("lat", "lon")]
    plane = values.reshape([spans[r][2] - spans[r][1] + 1 for r in order])
    if order == ["lon", "lat"]:
        plane = plane.T
    notes = _attributes(das, variable)
    for fill in (notes.get("_FillValue"), notes.get("missing_value")):
        if fill is not None:
            plane = np.where(np.isclose(plane, float(fill), rtol=1e-6), np.nan, plane)
    plane = plane * float(notes.get("scale_factor", 1)) + float(notes.get("add_offset", 0))
    when = None
    if "time" in spans:
        name, at, _ = spans["time"]
        when = moment(float(axes[name][at]), _attributes(das, name).get("units", "seconds since 1970-01-01"))
    depth = spans["depth"][1] if "depth" in spans else None
    (y_name, y0, y1), (x_name, x0, x1) = spans["lat"], spans["lon"]
    ys, xs = axes[y_name], axes[x_name]
    return [Plane(when, depth, numbers(ys)[y0 : y1 + 1], numbers(xs)[x0 : x1 + 1], ys[y0 : y1 + 1], xs[x0 : x1 + 1], plane)]
