"""An opener of NetCDF files in the classic formats, for ``read_cube`` (OP-03, 04), and a writer of them.

Only the rows of a band are read from a file, by their place in it. Files must lie where every executor can open them by path, such as
a mounted shared folder. A key is ``path|variable|time index|depth index``; the last two may be empty where the variable has no such
dimension. Files in the HDF5-based format (NetCDF-4) are refused.
"""

from __future__ import annotations

import datetime
import math
import struct
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from .cubes import Plane
from .dap import AXES, inside, moment, numbers

#: The format's tags, and its types by number.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    notes: dict[str, object]
    type: np.dtype
    begin: int
    record: bool
    size: int


@dataclass
class Header:
    """What a file says of itself; ``stride`` is the size of one record of all variables that have the unlimited dimension."""

    records: int = 0
    variables: dict[str, Variable] = field(default_factory=dict)
    stride: int = 0


class _Cursor:
    def __init__(self, f: BinaryIO, wide: bool):
        self.f, self.wide = f, wide

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.f.read(size), "big")

    def count(self) -> int:
        return self.number(8 if self.wide else 4)

    def padded(self, n: int) -> bytes:
        return self.f.read(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def items(self, tag: int) -> range:
        found, n = self.number(), self.count()
        if found not in (0, tag) or (not found and n):
            raise OSError("not a header of the classic format")
        return range(n)

    def notes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in self.items(ATTRIBUTE):
            name, kind, n = self.name(), self.number(), self.count()
            values = np.frombuffer(self.padded(n * np.dtype(TYPES[kind]).itemsize), TYPES[kind])
            out[name] = values.tobytes().decode(errors="replace") if kind == 2 else (values[0].item() if n == 1 else values.tolist())
        return out


def header(f: BinaryIO) -> Header:
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise OSError("not a NetCDF file of a classic format")
    at = _Cursor(f, magic[3] == 5)
    out = Header(at.count())
    if out.records == (1 << 64) - 1 or (magic[3] != 5 and out.records == (1 << 32) - 1):
        raise OSError("a file that is still being written")
    dims = [(at.name(), at.count()) for _ in at.items(DIMENSION)]
    at.notes()
    for _ in at.items(VARIABLE):
        name = at.name()
        ids = [at.count() for _ in range(at.count())]
        notes, kind = at.notes(), np.dtype(TYPES[at.number()])
        at.count()  # the size is reckoned here: the header's overflows for large variables
        begin = at.number(4 if magic[3] == 1 else 8)
        record = bool(ids) and dims[ids[0]][1] == 0
        shape = [dims[i][1] or out.records for i in ids]
        out.variables[name] = Variable([dims[i][0] for i in ids], shape, notes, kind, begin, record, math.prod(shape[record:]) * kind.itemsize)
    own = [v for v in out.variables.values() if v.record]
    out.stride = own[0].size if len(own) == 1 else sum(-(-v.size // 4) * 4 for v in own)
    return out


def read_part(f: BinaryIO, h: Header, name: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The values within closed ranges of indices, one for each dimension. Rows of the last two dimensions are read in one piece."""
    v = h.variables[name]
    lead, rest = spans[:-2], spans[-2:]
    shape = v.shape[-len(rest) :] if rest else []
    tail = math.prod(shape[1:]) * v.type.itemsize
    out = []
    for i in np.ndindex(*[z - a + 1 for a, z in lead]):
        place, at = v.begin, 0
        index = [a + k for (a, _), k in zip(lead, i, strict=True)]
        inner = index
        if v.record:
            record = index[0] if index else None
            inner = index[1:]
            place += 0 if record is None else record * h.stride
        for n, k in zip(v.shape[v.record and bool(index) :], inner, strict=False):
            at = at * n + k
        place += at * math.prod(shape) * v.type.itemsize
        first, last = rest[0]
        if v.record and not index:  # the records are the rows
            rows = []
            for k in range(first, last + 1):
                f.seek(v.begin + k * h.stride)
                rows.append(f.read(tail))
            data = b"".join(rows)
        else:
            f.seek(place + first * tail)
            data = f.read((last - first + 1) * tail)
        if len(data) < (last - first + 1) * tail:
            raise OSError(f"{name}: the file ends too soon")
        block = np.frombuffer(data, v.type).reshape(last - first + 1, *shape[1:])
        out.append(block[:, rest[1][0] : rest[1][1] + 1] if len(rest) > 1 else block)
    return np.stack(out).reshape([z - a + 1 for a, z in spans])


def open_bands(key: str, box: dict[str, tuple[float, float]]) -> list[Plane]:
    """The plane of one time and depth inside the box. Fill values and NaN are missing; indices count from the lesser coordinate."""
    path, variable, time_index, depth_index = (key.split("|") + ["", ""])[:4]
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        h = header(f)
        if variable not in h.variables:
            raise OSError(f"no variable {variable}")
        v = h.variables[variable]
        role = {n: r for r, names in AXES.items() for n in v.dims if n.lower() in names}
        axis = lambda n: read_part(f, h, n, [(0, h.variables[n].shape[0] - 1)]).astype(float) if n in h.variables else np.arange(v.shape[v.dims.index(n)], dtype=float)
        axes = {r: axis(n) for n, r in role.items()}
        if not {"lat", "lon"} <= axes.keys():
            raise OSError(f"{variable} has no latitude or longitude")
        spans = []
        for n, size in zip(v.dims, v.shape, strict=True):
            r = role.get(n)
            if r in ("lat", "lon"):
                span = inside(axes[r], box.get(r, (-math.inf, math.inf)))
                if span is None:
                    return []
            else:
                at = int((time_index if r == "time" else depth_index) or 0)
                if not 0 <= at < size:
                    raise OSError(f"{n} has no index {at}")
                span = (at, at)
            spans.append(span)
        values = read_part(f, h, variable, spans).astype(float)
        order = [role[n] for n in v.dims if role.get(n) in ("lat", "lon")]
        plane = values.reshape([z - a + 1 for n, (a, z) in zip(v.dims, spans, strict=True) if role.get(n) in ("lat", "lon")])
        if order == ["lon", "lat"]:
            plane = plane.T
        for fill in (v.notes.get("_FillValue"), v.notes.get("missing_value")):
            if isinstance(fill, int | float):
                plane = np.where(np.isclose(plane, fill, rtol=1e-6), np.nan, plane)
        plane = plane * float(v.notes.get("scale_factor", 1)) + float(v.notes.get("add_offset", 0))
        span_of = {role.get(n, n): s for n, s in zip(v.dims, spans, strict=True)}
        when = None
        if "time" in axes:
            units = next((h.variables[n].notes.get("units") for n, r in role.items() if r == "time" and n in h.variables), None)
            when = moment(float(axes["time"][span_of["time"][0]]), str(units or "seconds since 1970-01-01"))
        depth = span_of["depth"][0] if "depth" in span_of else None
        (y0, y1), (x0, x1) = span_of["lat"], span_of["lon"]
        ys, xs = axes["lat"], axes["lon"]
        return [Plane(when, depth, numbers(ys)[y0 : y1 + 1], numbers(xs)[x0 : x1 + 1], ys[y0 : y1 + 1], xs[x0 : x1 + 1], plane)]


def times(path: str, name: str = "time") -> list[datetime.datetime]:
    """The moments of a file's time axis, so that keys can carry them."""
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        h = header(f)
        at = read_part(f, h, name, [(0, h.variables[name].shape[0] - 1)])
        return [moment(float(x), str(h.variables[name].notes.get("units", "seconds since 1970-01-01"))) for x in at]


def write_classic(path: str, axes: dict[str, np.ndarray], variable: str, values: np.ndarray, units: str | None = None, fill: float = -9999.0, record: bool = False) -> None:
    """A file of one variable over its axes in order, 64-bit offsets, doubles; NaN becomes the fill value. ``record``: the first axis is unlimited."""
    text = lambda s: struct.pack(">I", len(s)) + s.encode() + bytes(-len(s) % 4)
    note = lambda n, x: text(n) + (struct.pack(">II", 2, len(x)) + x.encode() + bytes(-len(x) % 4) if isinstance(x, str) else struct.pack(">IId", 6, 1, x))
    some = lambda tag, items: struct.pack(">II", tag if items else 0, len(items)) + b"".join(items)
    names = list(axes)
    sizes = [len(a) for a in axes.values()]
    put = [(n, [i], some(ATTRIBUTE, [note("units", units)] if n == "time" and units else []), np.asarray(a, ">f8"), record and not i) for i, (n, a) in enumerate(axes.items())]
    put.append((variable, list(range(len(names))), some(ATTRIBUTE, [note("_FillValue", fill)]), np.where(np.isnan(values), fill, values).astype(">f8"), record))

    def head(places: list[int]) -> bytes:
        dims = [text(n) + struct.pack(">I", 0 if record and not i else k) for i, (n, k) in enumerate(zip(names, sizes, strict=True))]
        each = [
            text(n) + struct.pack(">I", len(ids)) + b"".join(struct.pack(">I", i) for i in ids) + notes + struct.pack(">IIQ", 6, min((d[:1].nbytes if r else d.nbytes), 0xFFFFFFFF), at)
            for (n, ids, notes, d, r), at in zip(put, places, strict=True)
        ]
        return b"CDF\x02" + struct.pack(">I", sizes[0] if record else 0) + some(DIMENSION, dims) + some(ATTRIBUTE, []) + some(VARIABLE, each)

    at, places = len(head([0] * len(put))), []
    for *_, d, r in sorted(put, key=lambda p: p[-1]):  # records come last
        places.append(at)
        at += d[:1].nbytes if r else d.nbytes
    order = sorted(range(len(put)), key=lambda i: put[i][-1])
    by = dict(zip(order, places, strict=True))
    with open(path, "wb") as f:
        f.write(head([by[i] for i in range(len(put))]))
        for i in order:
            if not put[i][-1]:
                f.write(put[i][3].tobytes())
        if record:
            for k in range(sizes[0]):
                for i in order:
                    if put[i][-1]:
                        f.write(put[i][3][k : k + 1].tobytes())  # a slice, as a scalar would lose its byte order
