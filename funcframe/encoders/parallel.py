"""Encoded samples as columns, made in the JVM and written by all tasks, for datasets that are too large for one stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcframe.dataset import Dataset
from funcframe.model import Function, Index, ModelError, Scalar, Type, col, column_id, columns, elements, range_, scalars, struct_type, top
from funcframe.operators import Uncurry
from funcframe.sources.files import record_layout


def _flat(ds: Dataset) -> Dataset:
    nested = [e for e in range_(ds.model) if isinstance(e, Function)]
    if any(isinstance(x, Function) for e in nested for x in elements(e.range)) or len(nested) > 1:
        raise ModelError("The dataset is too complex for this form")
    return ds.with_operation(Uncurry()) if nested else ds


def _shown(c: Column, s: Scalar) -> Column:
    text = c.cast("string")
    if "precision" in s.meta:
        text = F.when(F.isnan(c) | (F.abs(c) == float("inf")), text).otherwise(F.format_string(f"%.{int(s.meta['precision'])}f", c.cast("double")))
    return F.coalesce(text, F.lit("null"))


def csv_lines(ds: Dataset) -> DataFrame:
    """A column ``value``: a line without its end for each sample, in order."""
    flat = _flat(ds)
    made = []
    for s in scalars(flat.model):
        if not isinstance(s, Index):
            t = _shown(col(s.id), s)
            made.append(F.when(t.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t))
    return flat.samples().select(F.concat_ws(",", *made).alias("value"))


def _json(c: Column, t: Type) -> Column:
    if isinstance(t, Function):
        inner = [e for e in top(t) if not isinstance(e, Index)]
        one = lambda x: F.concat(F.lit("["), F.concat_ws(",", *[_json(x[column_id(e)], e) for e in inner]), F.lit("]"))
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, one), ","), F.lit("]")), F.lit("null"))
    if t.kind in ("string", "char", "binary", "bigdecimal", "bigint"):
        whole = F.to_json(F.array(c.cast("string")))
        return F.substring(whole, F.lit(2), F.length(whole) - 2)
    text = c.cast("string")
    if t.kind in ("float", "double"):
        text = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit("null")).otherwise(text)
    return F.coalesce(text, F.lit("null"))


def json_rows(ds: Dataset) -> DataFrame:
    """A column ``value``: an array of the variables for each sample; NaN is null."""
    made = [_json(col(column_id(e)), e) for e in top(ds.model) if not isinstance(e, Index)]
    return ds.samples().select(F.concat(F.lit("["), F.concat_ws(",", *made), F.lit("]")).alias("value"))


def text_rows(ds: Dataset) -> DataFrame:
    """A column ``value``: ``domain -> range`` for each sample of a dataset without index and nested function."""
    m = ds.model
    if any(isinstance(e, (Function, Index)) for e in top(m)):
        raise ModelError("The dataset is too complex for this form")

    def tuple_of(items: list[Scalar]) -> Column:
        shown = F.concat_ws(", ", *[_shown(col(s.id), s) for s in items])
        return shown if len(items) == 1 else F.concat(F.lit("("), shown, F.lit(")"))

    left = elements(m.domain) if isinstance(m, Function) else []
    body = tuple_of(range_(m))
    return ds.samples().select((F.concat(tuple_of(left), F.lit(" -> "), body) if left else body).alias("value"))


def write_lines(lines: DataFrame, path: str, end: str = "\n") -> None:
    """The lines of :func:`csv_lines` and others, a file for each range of the order."""
    lines.write.option("lineSep", end).text(path)


def record_type(model: Type) -> np.dtype:
    """Big-endian records of fixed width as numpy sees them."""
    kinds = {"?": "?", "b": "i1", "h": ">i2", "i": ">i4", "q": ">i8", "f": ">f4", "d": ">f8"}
    return np.dtype([(s.id, f"S{c[:-1]}" if c.endswith("s") else kinds[c]) for s, c in record_layout(model)])


def binary_blocks(ds: Dataset) -> DataFrame:
    """A column ``body``: the records of a run of samples, one for each Arrow batch, in order."""
    flat = _flat(ds)
    layout, kind = record_layout(flat.model), record_type(flat.model)
    names = [s.id for s, _ in layout]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, dtype=kind)
            for name, (s, c), column in zip(names, layout, b.columns, strict=True):
                if column.null_count:
                    raise ModelError(f"Null in {name}")
                out[name] = [v.encode().ljust(int(s.meta["size"])) for v in column.to_pylist()] if c.endswith("s") else column.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], type=pa.binary())], names=["body"])

    return flat.samples().select(*[col(n) for n in names]).mapInArrow(pack, "body binary")


def records_of(blocks: DataFrame, model: Type) -> DataFrame:
    """The samples of a binary column of whole records; an incomplete last record is dropped."""
    kind, schema = record_type(model), struct_type(model)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                raw = body.as_buffer()
                got = np.frombuffer(raw, dtype=kind, count=len(raw) // kind.itemsize)
                made = []
                for name in kind.names:
                    v = got[name]
                    made.append(pa.array([x.decode().rstrip("\0 ") for x in v.tolist()], type=pa.string()) if v.dtype.kind == "S" else pa.array(np.ascontiguousarray(v).astype(v.dtype.newbyteorder("="))))
                yield pa.RecordBatch.from_arrays(made, names=list(kind.names))

    return blocks.mapInArrow(unpack, schema)


__all__ = ["binary_blocks", "columns", "csv_lines", "json_rows", "record_type", "records_of", "text_rows", "write_lines"]
