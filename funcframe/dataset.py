"""Datasets: a model, a source of samples and a list of operators, all immutable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcframe import operators as ops
from funcframe.model import ORD, Function, Type, col, columns, find, parse
from funcframe.operators.combining import append
from funcframe.operators.reading import read_each


@dataclass(frozen=True)
class Dataset:
    """``source`` gives the samples when they are asked for; nothing runs before that."""

    id: str
    source_model: Type
    source: Callable[[], DataFrame]
    operations: tuple[ops.Operator, ...] = ()
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of(cls, id: str, model: str | Type, df: DataFrame, **metadata: str) -> Dataset:
        """From a DataFrame that has the model's columns."""
        m = parse(model) if isinstance(model, str) else model
        keep = [col(c) for c in columns(m)] + ([F.col(ORD)] if ORD in df.columns else [])
        return cls(id, m, lambda: df.select(*keep), (), metadata)

    @property
    def model(self) -> Type:
        m = self.source_model
        for op in self.operations:
            m = op.apply_model(m)
        return m

    @property
    def history(self) -> str:
        return "; ".join(filter(None, [self.metadata.get("history", ""), *map(str, self.operations)]))

    def with_operation(self, op: ops.Operator) -> Dataset:
        new = replace(self, operations=(*self.operations, op))
        _ = new.model  # errors of the request come before any job
        return new

    def with_operations(self, more: list[ops.Operator]) -> Dataset:
        out = self
        for op in more:
            out = out.with_operation(op)
        return out

    def query(self, expression: str) -> Dataset:
        """By a constraint expression, such as ``a,b&a>=3&take(10)``."""
        return self.with_operations(ops.from_expression(expression))

    def with_order(self) -> DataFrame:
        """The samples, unsorted, with the hidden place where there is one."""
        m, df = self.source_model, self.source()
        todo = list(self.operations)
        while todo:
            op = todo.pop(0)
            if todo and isinstance(todo[0], ops.Uncurry) and (flat := ops.flat(op, df, m)) is not None:
                m = todo.pop(0).apply_model(op.apply_model(m))  # nesting and laying out flat again is no work
                df = flat.select(*[col(c) for c in columns(m)])
                continue
            df = op.apply(df, m)
            m = op.apply_model(m)
        return df

    def samples(self, sort: bool = True) -> DataFrame:
        """The samples as columns of the model, in their order unless ``sort`` is false."""
        from funcframe.model import order

        df, m = self.with_order(), self.model
        if sort and isinstance(m, Function) and (ORD in df.columns or all(type(s).__name__ != "Index" for s in _domain(m))):
            df = df.orderBy(*order(m, False, df.columns))
        return df.select(*[col(c) for c in columns(m)])

    def cache(self) -> Dataset:
        df = self.with_order().persist()
        return replace(self, source_model=self.model, source=lambda: df, operations=(), metadata=self.metadata | {"history": self.history})

    # The operators as methods

    def __getattr__(self, name: str):
        made = _METHODS.get(name)
        if made is None:
            raise AttributeError(name)
        return lambda *args, **named: self.with_operation(made(*args, **named))

    def lookup(self) -> ops.Known:
        return ops.Known(self.model, self.with_order())


def _domain(m: Type) -> list:
    from funcframe.model import domain

    return domain(m)


_METHODS: dict[str, Callable[..., ops.Operator]] = {
    "project": ops.Projection, "rename": ops.Rename, "contains": ops.Contains, "filter": ops.Filter, "take": ops.Take, "take_right": ops.TakeRight, "drop": ops.Drop, "drop_right": ops.DropRight, "drop_last": ops.DropLast,
    "head": ops.Head, "last": ops.Last, "tail": ops.Tail, "stride": ops.Stride, "count": ops.Count, "stats": ops.Stats, "sum": ops.Sum, "count_by": ops.CountBy, "group_by": ops.GroupBy, "group_by_bin": ops.GroupByBin,
    "group_by_bin_width": ops.GroupByBinWidth, "integrate": ops.SumIntegration, "curry": ops.Curry, "curry_right": ops.CurryRight, "uncurry": ops.Uncurry, "pivot": ops.Pivot, "transpose": ops.Transpose,
    "make_cartesian": ops.MakeCartesian, "evaluation": ops.Evaluation, "resample": ops.Resample, "compose": ops.Composition, "substitute": ops.Substitution, "on_change": ops.OnChange, "max_delta": ops.MaxDelta,
    "max_gap": ops.MaxGap, "convert_time": ops.ConvertTime, "format_time": ops.FormatTime, "time_tuple_to_time": ops.TimeTupleToTime, "to_binary": lambda i: ops.ConvertBinary(i, 2), "to_hex": lambda i: ops.ConvertBinary(i, 16),
    "to_base64": lambda i: ops.ConvertBinary(i, 64), "map": ops.MapSamples, "map_rows": ops.MapRows, "filter_rows": ops.FilterRows, "with_reader": ops.WithReader, "interpolate": ops.Interpolate, "without": ops.RemoveVariables, "select": lambda *a: ops.Selection.parse(a[0]) if len(a) == 1 else ops.Selection(*a),
}


@dataclass(frozen=True)
class Composite(Dataset):
    """Datasets one behind the other. Operators that work sample by sample go into each member, and those that take by
    place both there and on the whole; the rest works on the union."""

    members: tuple[Dataset, ...] = ()

    @classmethod
    def of_members(cls, id: str, members: list[Dataset]) -> Composite:
        return cls(id, members[0].model, lambda: _union(members), (), {}, tuple(members))

    def with_operation(self, op: ops.Operator) -> Dataset:
        each = isinstance(op, (ops.Filter, ops.Rename, ops.Taking))
        if self.operations or not each:
            return super().with_operation(op)
        members = [m.with_operation(op) for m in self.members]
        new = Composite.of_members(self.id, members)
        return Dataset.with_operation(new, op) if isinstance(op, ops.Taking) else new


def _union(members: list[Dataset]) -> DataFrame:
    """A member that cannot be read counts as empty."""
    parts, last = [], None
    for m in members:
        try:
            df = m.with_order()
            _ = df.schema
        except Exception as e:  # noqa: BLE001
            last = e
            continue
        parts.append((m.model, df))
    if not parts:
        raise last
    return append(parts)[1]


def granules(id: str, listed: Dataset, read: Callable[[list[str]], DataFrame] | None, model: Type, uri: str = "uri", each: Callable[[bytes], list[dict]] | None = None) -> Dataset:
    """A dataset of files that a list names. A selection by the list's domain leaves files unread.

    With ``each``, a function of a file's bytes, tasks read the files and the list stays distributed. With ``read``, a
    Spark reader of paths, the list (a row for each file) comes to the driver; samples never do.
    """

    @dataclass(frozen=True)
    class Granules(Dataset):
        def with_operation(self, op: ops.Operator) -> Dataset:
            out = Dataset.with_operation(self, op)
            known = {s.id for s in _domain(listed.model)}
            may_prune = all(isinstance(o, (ops.Filter, ops.Projection, ops.Rename)) for o in self.operations)
            if isinstance(op, ops.Selection) and op.id in known and may_prune and op.id in {s.id for s in _domain(self.model)}:
                wide = {">": ">=", "<": "<="}.get(op.op, op.op)
                pruned = listed.with_operation(ops.Selection(op.id, wide, op.value)) if wide != "!=" else listed
                base = granules(id, pruned, read, model, uri, each)
                return replace(base, operations=out.operations)
            return out

    find(listed.model, uri)

    def source() -> DataFrame:
        if each:
            return read_each(listed.with_order(), uri, each, model)
        paths = [r[0] for r in listed.samples().select(col(uri)).collect()]
        return read(paths)

    return Granules(id, model, source)
