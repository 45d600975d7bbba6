"""Operators given as Python functions of samples, readers of named resources, and bound binary operators.

Samples go to the functions in Arrow batches; expressions on columns (``Filter``, ``MapSamples``) stay in the JVM and are
the faster way where they can say the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from funcframe.model import ORD, Function, ModelError, Type, column_id, columns, domain, elements, find, function, range_, struct_type
from funcframe.operators.base import Operator
from funcframe.operators.combining import append


class MapRows(Operator):
    """``f`` of a sample as a dict gives a new one; a sample for which it raises an error is dropped."""

    drop_errors, many = True, False

    def __init__(self, f: Callable[[dict], object], model: Type | None = None) -> None:
        self.f, self.model = f, model

    def apply_model(self, m: Type) -> Type:
        return self.model or m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        f, many, drop, names = self.f, self.many, self.drop_errors, columns(self.apply_model(m))
        schema = struct_type(self.apply_model(m))
        if ORD in df.columns:
            schema = schema.add(ORD, df.schema[ORD].dataType)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    try:
                        got = f(row)
                    except Exception:
                        if not drop:
                            raise
                        continue
                    for one in got if many else [got]:
                        out.append({c: one.get(c) for c in names} | ({ORD: row[ORD]} if ORD in row else {}))
                yield pd.DataFrame(out, columns=schema.names)

        return df.mapInPandas(run, schema)


class MapRangeRows(MapRows):
    """As :class:`MapRows` for functions that may not fail: an error ends the query."""

    drop_errors = False


class FlatMapRows(MapRows):
    """``f`` gives a list of samples for each sample."""

    many = True


class FilterRows(MapRows):
    """Keeps the samples for which ``f`` is true; where it raises an error the sample is dropped."""

    def __init__(self, f: Callable[[dict], object]) -> None:
        super().__init__(lambda row: [row] if f(row) else [])
        self.many = True


def delimited(model: Type, delimiter: str = ",") -> Callable[[bytes], list[dict]]:
    """A reader of lines of delimited texts; lines that do not fit are left out."""
    make = {"int": int, "long": int, "short": int, "byte": int, "double": float, "float": float, "boolean": lambda v: {"true": True, "false": False}[v.lower()]}
    fields = [(s.id, make.get(s.kind, str)) for s in [*domain(model), *range_(model)]]

    def read(body: bytes) -> list[dict]:
        out = []
        for line in body.decode().split("\n"):
            parts = line.strip("\r").split(delimiter)
            try:
                out.append({i: f(v) for (i, f), v in zip(fields, parts, strict=True)})
            except (ValueError, KeyError):
                continue
        return out

    return read


def _nested(model: Type) -> Function:
    if not isinstance(model, Function):
        raise ModelError("A reader gives a function")
    return model


class WithReader(Operator):
    """The range, one text with a URI, becomes the dataset that a reader makes of its bytes, as a nested function.

    Tasks fetch the resources; what one holds is one value, as a nested function is. :func:`read_each` keeps it flat.
    """

    def __init__(self, read: Callable[[bytes], list[dict]], model: Type) -> None:
        self.read, self.model = read, _nested(model)

    def _uri(self, m: Type) -> str:
        r = range_(m)
        if not isinstance(m, Function):
            raise ModelError("Model is not a function")
        if len(r) != 1 or find(m, column_id(r[0])).kind != "string":
            raise ModelError("URI variable must be of type text")
        return r[0].id

    def apply_model(self, m: Type) -> Type:
        self._uri(m)
        return function(domain(m), [self.model])

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        uri, name, read = self._uri(m), column_id(self.model), self.read
        keep = [c for c in df.columns if c != uri]
        schema = df.select(*[f"`{c}`" for c in keep]).schema.add(name, struct_type(self.apply_model(m))[name].dataType)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from funcframe.sources.files import fetch

            for pdf in batches:
                yield pdf[keep].assign(**{name: [read(fetch(u)) for u in pdf[uri]]})

        return df.mapInPandas(run, schema)


def read_each(listed: DataFrame, uri: str, read: Callable[[bytes], list[dict]], model: Type) -> DataFrame:
    """The samples of all resources that a list names, read by tasks, one resource at a time; the list stays distributed."""
    names, schema = columns(model), struct_type(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from funcframe.sources.files import fetch

        for pdf in batches:
            for u in pdf[uri]:
                yield pd.DataFrame(read(fetch(u)), columns=names)

    return listed.select(f"`{uri}`").mapInPandas(run, schema)


class BinaryOperation:
    """A combination of two datasets, given as models and DataFrames."""

    def apply_model(self, a: Type, b: Type) -> Type:
        raise NotImplementedError

    def apply(self, a: tuple[Type, DataFrame], b: tuple[Type, DataFrame]) -> DataFrame:
        raise NotImplementedError


class Join(BinaryOperation):
    """A binary operation that equals itself over parts: operators in ``each`` may run on both sides first."""

    each: tuple[type, ...] = ()


class AppendJoin(Join):
    """The samples of the left dataset, then those of the right; variables have to match by place."""

    def apply_model(self, a: Type, b: Type) -> Type:
        kinds = lambda m: [(len(domain(m)), len(range_(m)))] + [getattr(e, "kind", None) for e in elements(group_of(m))]
        if kinds(a) != kinds(b):
            raise ModelError("The models differ")
        return a

    def apply(self, a: tuple[Type, DataFrame], b: tuple[Type, DataFrame]) -> DataFrame:
        return append([a, b])[1]


def group_of(m: Type) -> Type:
    from funcframe.model import group

    return group([*domain(m), *range_(m)])


class Bound(Operator):
    """A binary operation with its left dataset given, as an operator on the right one."""

    def __init__(self, operation: BinaryOperation, left) -> None:
        self.operation, self.left = operation, left

    def apply_model(self, m: Type) -> Type:
        return self.operation.apply_model(self.left.model, m)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return self.operation.apply((self.left.model, self.left.with_order()), (m, df))


__all__ = ["AppendJoin", "BinaryOperation", "Bound", "FilterRows", "FlatMapRows", "Join", "MapRangeRows", "MapRows", "WithReader", "delimited", "read_each"]
