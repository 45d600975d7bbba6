"""netCDF classic files (CDF-1, CDF-2 and CDF-5) without a library: headers on the driver, slabs of values in tasks.

A dataset of one to three dimensions has a one-dimensional variable for each domain variable, named like it, and range
variables over all dimensions in order. Tasks read their own runs of samples from a path that all executors share.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe import operators as ops
from funcframe.dataset import Dataset
from funcframe.model import Function, Index, ModelError, Scalar, Type, col, domain, range_, struct_type
from funcframe.plans.sequence import with_ordinal

#: Type codes of the format and their big-endian forms.
NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Type codes for value types.
CODES = {"boolean": 1, "byte": 1, "string": 2, "short": 3, "int": 4, "float": 5, "double": 6, "long": 10}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
#: Samples that one task reads at a time.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[int, ...]
    code: int
    begin: int
    meta: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Header:
    """``dims``: (name, length); ``records``: how many records the unlimited dimension ``unlimited`` has, and their size."""

    dims: tuple[tuple[str, int], ...]
    variables: dict[str, Variable]
    unlimited: int = -1
    record_size: int = 0

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dims[d][1] for d in self.variables[name].dims)


def header(path: str) -> Header:
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3:4] not in (b"\1", b"\2", b"\5"):
            raise ModelError("Not a netCDF classic file")
        size, place = (">q", 8) if magic[3] == 5 else (">i", 4), (">i", 4) if magic[3] == 1 else (">q", 8)
        number = lambda form=size: struct.unpack(form[0], f.read(form[1]))[0]
        code = lambda: struct.unpack(">i", f.read(4))[0]

        def padded(n: int) -> bytes:
            return f.read(n + -n % 4)[:n]

        def name() -> str:
            return padded(number()).decode()

        def attributes() -> dict:
            out = {}
            _, n = code(), number()
            for _ in range(n):
                key, kind, count = name(), code(), number()
                raw = padded(count * np.dtype(NC_TYPES[kind]).itemsize)
                values = np.frombuffer(raw, dtype=NC_TYPES[kind])
                out[key] = raw.decode() if kind == 2 else values.tolist()[0] if len(values) == 1 else values.tolist()
            return out

        records = number()
        code()
        dims = [(name(), number()) for _ in range(number())]
        attributes()
        code()
        variables, sizes = {}, {}
        for _ in range(number()):
            key = name()
            own = tuple(number() for _ in range(number()))
            meta, kind, held, begin = attributes(), code(), number(), number(place)
            variables[key], sizes[key] = Variable(key, own, kind, begin, meta), held
        unlimited = next((i for i, (_, n) in enumerate(dims) if n == 0), -1)
        in_records = [k for k, v in variables.items() if v.dims[:1] == (unlimited,)]
        row = lambda k: int(np.prod([dims[d][1] for d in variables[k].dims[1:]], dtype=np.int64)) * np.dtype(NC_TYPES[variables[k].code]).itemsize
        record_size = row(in_records[0]) if len(in_records) == 1 else sum(sizes[k] for k in in_records)
        if unlimited >= 0:
            if records < 0:
                raise ModelError("The number of records is not known")
            dims[unlimited] = (dims[unlimited][0], records)
        return Header(tuple(dims), variables, unlimited, record_size)


def values(path: str, h: Header, name: str, a: int, b: int) -> np.ndarray:
    """Elements a to b of a variable in the order of the file."""
    v = h.variables[name]
    kind = np.dtype(NC_TYPES[v.code])
    with open(path, "rb") as f:
        if not v.dims or v.dims[0] != h.unlimited:
            f.seek(v.begin + a * kind.itemsize)
            return np.frombuffer(f.read((b - a) * kind.itemsize), dtype=kind)
        inner = max(1, math.prod(h.shape(name)[1:]))
        out = []
        for record in range(a // inner, -(-b // inner)):
            f.seek(v.begin + record * h.record_size)
            out.append(np.frombuffer(f.read(inner * kind.itemsize), dtype=kind))
        flat = np.concatenate(out) if out else np.zeros(0, dtype=kind)
        return flat[a - a // inner * inner :][: b - a]


def _read(path: str, h: Header, name: str, s: Scalar, a: int, b: int) -> pa.Array:
    if s.kind == "string":
        width = h.shape(name)[-1]
        raw = values(path, h, name, a * width, b * width).tobytes()
        return pa.array([raw[i : i + width].decode().rstrip("\0 ") for i in range(0, len(raw), width)], type=pa.string())
    got = values(path, h, name, a, b)
    got = got.astype(got.dtype.newbyteorder("="))
    return pa.array(got != 0) if s.kind == "boolean" else pa.array(got.astype({"byte": "i1", "short": "i2", "int": "i4", "long": "i8", "float": "f4", "double": "f8"}[s.kind]))


@dataclass(frozen=True)
class Slab:
    """A range and a step of positions for each dimension."""

    ranges: tuple[range, ...]

    def count(self) -> int:
        return math.prod(map(len, self.ranges))


@dataclass(frozen=True)
class Netcdf(Dataset):
    """Selections of a domain variable and leading strides narrow the slab that is read."""

    path: str = ""
    slab: Slab = Slab(())

    @classmethod
    def of_file(cls, id: str, model: Type, path: str, spark: SparkSession) -> Netcdf:
        h = header(path)
        d = domain(model)
        if not 1 <= len(d) <= 3 or any(isinstance(s, Index) for s in d) or any(isinstance(e, Function) for e in range_(model)):
            raise ModelError("A netCDF dataset has one to three dimensions and no nested function")
        name = lambda s: s.meta.get("sourceId", s.id)
        for s in [*d, *range_(model)]:
            if name(s) not in h.variables:
                raise ModelError(f"No such variable: {name(s)}")
        lengths = [h.shape(name(s))[0] for s in d]
        for s in range_(model):
            if list(h.shape(name(s)))[: len(d)] != lengths:
                raise ModelError(f"The shape does not fit the domain: {s.id}")
        slab = Slab(tuple(map(range, lengths)))
        return cls(id, model, lambda: read_slab(spark, model, path, slab), (), {}, path, slab)

    def _narrowed(self, ranges: list[range]) -> Netcdf:
        slab, spark, model, path = Slab(tuple(ranges)), SparkSession.getActiveSession(), self.source_model, self.path
        return replace(self, slab=slab, source=lambda: read_slab(spark, model, path, slab))

    def with_operation(self, op: ops.Operator) -> Dataset:
        out = Dataset.with_operation(self, op)
        d = domain(self.source_model)
        if all(isinstance(o, ops.Selection) for o in self.operations) and isinstance(op, ops.Selection) and op.op in ("<", "<=", ">", ">=", "=", "=="):
            for k, s in enumerate(d):
                if s.id == op.id and s.kind not in ("string", "boolean") and not s.is_time:
                    h, own = header(self.path), list(self.slab.ranges)
                    at = values(self.path, h, s.meta.get("sourceId", s.id), 0, len(range(h.shape(s.meta.get("sourceId", s.id))[0]))).astype(float)
                    if len(at) > 1 and not (np.diff(at) > 0).all():
                        return out  # only an ascending domain can be cut
                    low, high = 0, len(at)
                    if op.op in (">", ">=", "=", "=="):
                        low = int(np.searchsorted(at, float(op.value), "left"))
                    if op.op in ("<", "<=", "=", "=="):
                        high = int(np.searchsorted(at, float(op.value), "right"))
                    r = own[k]
                    own[k] = range(max(r.start, low), min(r.stop, high))
                    return replace(self._narrowed(own), operations=out.operations)
        if not self.operations and isinstance(op, ops.Stride) and len(op.steps) in (1, len(d)) and len(d) == len(op.steps):
            return self._narrowed([r[::n] for r, n in zip(self.slab.ranges, op.steps, strict=True)])
        return out


def read_slab(spark: SparkSession, model: Type, path: str, slab: Slab) -> DataFrame:
    """The samples of a slab, in runs of ``CHUNK`` that tasks read by themselves."""
    h, d, r = header(path), domain(model), range_(model)
    n, schema = slab.count(), struct_type(model)
    name = lambda s: s.meta.get("sourceId", s.id)
    lengths = tuple(h.shape(name(s))[0] for s in d)
    chunks = max(1, -(-n // CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = [_read(path, h, name(s), s, 0, k) for s, k in zip(d, lengths, strict=True)] if len(d) > 1 else []
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                a, b = chunk * CHUNK, min((chunk + 1) * CHUNK, n)
                if a >= b:
                    continue
                places = np.unravel_index(np.arange(a, b), tuple(map(len, slab.ranges)))
                full = [np.asarray(q.start + p * q.step) for p, q in zip(places, slab.ranges, strict=True)]
                flat = np.ravel_multi_index(full, lengths)
                low, high = int(flat[0]), int(flat[-1]) + 1
                made = [axis.take(pa.array(p)) for axis, p in zip(axes, full, strict=True)] if axes else [_read(path, h, name(d[0]), d[0], low, high).take(pa.array(flat - low))]
                made += [_read(path, h, name(s), s, low, high).take(pa.array(flat - low)) for s in r]
                yield pa.RecordBatch.from_arrays(made, names=[s.id for s in [*d, *r]])

    return spark.range(0, chunks, 1, min(chunks, 10_000)).mapInArrow(run, schema)


def write(ds: Dataset, path: str) -> None:
    """A Cartesian dataset as one CDF-5 file: distinct domain values are the dimensions, samples have to fill them.

    Tasks pack runs of samples in order; the driver holds one run at a time and writes each variable's part to its place.
    """
    m, d, r = ds.model, domain(ds.model), range_(ds.model)
    if not 1 <= len(d) <= 3 or any(isinstance(s, Index) for s in d) or any(isinstance(e, Function) for e in r):
        raise ModelError("A netCDF dataset has one to three dimensions and no nested function")
    for s in [*d, *r]:
        if s.kind not in CODES or s.kind == "string" and "size" not in s.meta:
            raise ModelError(f"No netCDF type for {s.id}")
    df = ds.with_order()
    n = df.count()
    axes: list[np.ndarray] | None = None
    if len(d) > 1:
        axes = [_packed(df.select(col(s.id)).distinct().orderBy(col(s.id).desc() if s.desc else col(s.id)).toArrow().column(0), s) for s in d]
        lengths = [len(a) for a in axes]
    else:
        lengths = [n]
    if math.prod(lengths) != n:
        raise ModelError("The samples are not Cartesian")
    widths = {s.id: int(s.meta["size"]) for s in [*d, *r] if s.kind == "string"}
    dims = [(s.id, k) for s, k in zip(d, lengths, strict=True)] + [(f"{i}_size", w) for i, w in widths.items()]
    number = lambda v: struct.pack(">q", v)
    code = lambda v: struct.pack(">i", v)
    text = lambda b: number(len(b)) + b + b"\0" * (-len(b) % 4)
    plan = [(s, (k,), lengths[k]) for k, s in enumerate(d)] + [(s, tuple(range(len(d))), n) for s in r]
    at = {i: len(d) + k for k, i in enumerate(widths)}

    def head(begins: dict[str, int]) -> bytes:
        out = b"CDF\5" + number(0) + code(_DIMENSION) + number(len(dims)) + b"".join(text(k.encode()) + number(v) for k, v in dims) + code(0) + number(0) + code(_VARIABLE) + number(len(plan))
        for s, own, count in plan:
            own = (*own, at[s.id]) if s.id in at else own
            meta = {k: str(v).encode() for k, v in s.meta.items() if k != "size"}
            atts = (code(_ATTRIBUTE) + number(len(meta)) + b"".join(text(k.encode()) + code(2) + text(v) for k, v in meta.items())) if meta else code(0) + number(0)
            size = count * _width(s)
            out += text(s.id.encode()) + number(len(own)) + b"".join(map(number, own)) + atts + code(CODES[s.kind]) + number(size + -size % 4) + number(begins.get(s.id, 0))
        return out

    begins, free = {}, len(head({}))
    for s, _, count in plan:
        begins[s.id] = free
        free += count * _width(s) + -(count * _width(s)) % 4
    columns = [s for s, _, _ in plan][0 if axes is None else len(d) :]
    rows = with_ordinal(df, [col(s.id).desc() if s.desc else col(s.id) for s in d], "__n").select(F.col("__n"), *[col(s.id) for s in columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(place) != 1) + 1
            for x, y in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if y > x:
                    made = [_packed(b.column(1 + k).slice(x, y - x), s).tobytes() for k, s in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([pa.array([place[x]]), *[pa.array([v], type=pa.large_binary()).cast(pa.binary()) for v in made]], names=["n", *[f"v{k}" for k in range(len(columns))]])

    with open(path, "wb") as f:
        f.write(head(begins))
        for s, axis in zip(d, axes or [], strict=False):
            f.seek(begins[s.id])
            f.write(axis.tobytes())
        for row in rows.mapInArrow(pack, "n long, " + ", ".join(f"v{k} binary" for k in range(len(columns)))).toLocalIterator():
            for k, s in enumerate(columns):
                f.seek(begins[s.id] + row[0] * _width(s))
                f.write(bytes(row[1 + k]))
        f.truncate(free)


def _width(s: Scalar) -> int:
    return int(s.meta["size"]) if s.kind == "string" else np.dtype(NC_TYPES[CODES[s.kind]]).itemsize


def _packed(column: pa.Array | pa.ChunkedArray, s: Scalar) -> np.ndarray:
    if s.kind == "string":
        return np.array([(v or "").encode()[: int(s.meta["size"])] for v in column.to_pylist()], dtype=f"S{int(s.meta['size'])}")
    if column.null_count:
        raise ModelError(f"Null in {s.id}")
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(NC_TYPES[CODES[s.kind]])
