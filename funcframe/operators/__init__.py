"""All operators, and the registry of those that requests can name."""

from __future__ import annotations

from collections.abc import Callable

from funcframe.model import ORD, Function, Index, ModelError, Type, domain, range_
from funcframe.operators.base import Aggregation, Filter, MapRange, MapSamples, Operator, Taking
from funcframe.operators.choosing import Contains, Drop, DropLast, DropRight, Head, Last, Projection, RemoveVariables, Rename, Selection, Stride, Tail, Take, TakeRight
from funcframe.operators.combining import Append, Composition, Computed, Known, Substitution
from funcframe.operators.converting import ConvertBinary, ConvertTime, FileListToZipList, FormatTime, TimeTupleToTime
from funcframe.operators.grouping import BinSet, Count, CountBy, Default, First, GroupBy, GroupByBin, GroupByBinWidth, Nearest, Stats, Sum, SumIntegration
from funcframe.operators.reading import AppendJoin, BinaryOperation, Bound, FilterRows, FlatMapRows, Join, MapRangeRows, MapRows, WithReader
from funcframe.operators.series import Interpolate, MaxDelta, MaxGap, OnChange
from funcframe.operators.shaping import Curry, CurryRight, Evaluation, MakeCartesian, Pivot, Resample, Transpose, Uncurry
from funcframe.plans import expressions


def _select(*args: str) -> Selection:
    return Selection.parse(args[0]) if len(args) == 1 else Selection(*args)


def flat(op: Operator, df, m: Type):
    """The samples of a grouping or currying operator that are laid out flat right behind it; None where that takes arrays."""
    if isinstance(op, GroupBy) and type(op.aggregation) is Default and isinstance(inner := op._inner(m), Function):
        names, need = op.ids, True
    elif isinstance(op, Curry):
        inner, names, need = op.apply_model(m), (), False
        inner = next((e for e in range_(inner) if isinstance(e, Function)), None)
    else:
        return None
    if inner is None or ORD in df.columns or any(isinstance(s, Index) for s in [*domain(m), *domain(inner)]) or any(isinstance(e, Function) for e in range_(m)):
        return None
    return df.where(" AND ".join(f"`{i}` IS NOT NULL" for i in names)) if need else df


#: name: (builder, least and most number of arguments)
REGISTRY: dict[str, tuple[Callable[..., Operator], int, int | None]] = {
    "contains": (Contains, 2, None), "convertTime": (ConvertTime, 1, 1), "count": (Count, 0, 0), "countBy": (CountBy, 1, None), "curry": (Curry, 0, 1), "curryRight": (CurryRight, 1, 1),
    "drop": (Drop, 1, 1), "dropLast": (DropLast, 0, 0), "dropRight": (DropRight, 1, 1), "eval": (Evaluation, 2, 2), "evaluation": (Evaluation, 2, 2), "first": (Head, 0, 0), "formatTime": (FormatTime, 1, 1),
    "groupBy": (GroupBy, 1, None), "groupByBinWidth": (GroupByBinWidth, 1, 2), "head": (Head, 0, 0), "last": (Last, 0, 0), "maxDelta": (MaxDelta, 2, 2), "maxGap": (MaxGap, 2, 2), "onChange": (OnChange, 1, 1),
    "pivot": (Pivot, 2, 2), "project": (Projection, 1, None), "rename": (Rename, 2, 2), "select": (_select, 1, 3), "stats": (Stats, 0, 0), "stride": (Stride, 1, None), "sum": (Sum, 0, 0), "tail": (Tail, 0, 0),
    "take": (Take, 1, 1), "takeRight": (TakeRight, 1, 1), "toBase64": (lambda i: ConvertBinary(i, 64), 1, 1), "toBinary": (lambda i: ConvertBinary(i, 2), 1, 1), "toHex": (lambda i: ConvertBinary(i, 16), 1, 1),
    "transpose": (Transpose, 0, 0), "timeTupleToTime": (TimeTupleToTime, 0, 1),
}


def register(name: str, builder: Callable[..., Operator], least: int = 0, most: int | None = None) -> None:
    """Makes an operator known to requests."""
    REGISTRY[name] = (builder, least, most)


def build(name: str, args: tuple) -> Operator:
    if name not in REGISTRY:
        raise ModelError(f"Unknown operation: {name}")
    builder, least, most = REGISTRY[name]
    if len(args) < least or most is not None and len(args) > most:
        raise ModelError(f"{name} requires {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(args)}")
    return builder(*args)


def from_expression(text: str, keep_quotes: bool = False) -> list[Operator]:
    """Operators of a constraint expression, in its order."""
    clean = (lambda a: a) if keep_quotes else (lambda a: tuple(map(clean, a)) if isinstance(a, tuple) else expressions.unquoted(a))
    out: list[Operator] = []
    for t in expressions.parse(text):
        if isinstance(t, expressions.Projection):
            out.append(Projection(*t.ids))
        elif isinstance(t, expressions.Selection):
            out.append(Selection(t.id, t.op, t.value))
        else:
            out.append(build(t.name, tuple(map(clean, t.args))))
    return out


__all__ = [
    "REGISTRY", "Aggregation", "Append", "AppendJoin", "BinSet", "BinaryOperation", "Bound", "Composition", "Computed", "Contains", "ConvertBinary", "ConvertTime", "Count", "CountBy", "Curry", "CurryRight", "Default", "Drop", "DropLast", "DropRight", "Evaluation",
    "FileListToZipList", "Filter", "FilterRows", "First", "FlatMapRows", "FormatTime", "GroupBy", "GroupByBin", "GroupByBinWidth", "Head", "Interpolate", "Join", "Known", "Last", "MakeCartesian", "MapRange", "MapRangeRows", "MapRows", "MapSamples", "MaxDelta", "MaxGap", "Nearest", "OnChange", "Operator", "Pivot",
    "Projection", "RemoveVariables", "Rename", "Resample", "Selection", "Stats", "Stride", "Substitution", "Sum", "SumIntegration", "Tail", "Take", "TakeRight", "Taking", "TimeTupleToTime", "Transpose", "Uncurry", "WithReader", "build", "flat", "from_expression", "register",
]
