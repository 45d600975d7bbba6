"""Projection, renaming and selection, and choosing samples by their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcframe.functions import times
from funcframe.model import NUMERIC, ORD, Function, Index, ModelError, Scalar, Tuple, Type, change, col, column_id, columns, domain, elements, find, function, group, order_parts, range_, scalars, top
from funcframe.operators.base import Filter, Operator, Taking, integer, keys, number
from funcframe.plans.expressions import OPERATORS, unquoted
from funcframe.plans.sequence import behind, with_ordinal


class Projection(Operator):
    """Keeps the named variables in the model's order.

    Without a domain variable the domain becomes an index; with all of them and no range they become the range. Part of a
    domain, or part of a nested function, is an error.
    """

    def __init__(self, *ids: str) -> None:
        if not ids:
            raise ModelError("A projection needs a variable")
        self.ids = ids

    def _kept(self, m: Type) -> list:
        return [e for e in top(m) if (all(s.id in self.ids for s in scalars(e)) or column_id(e) in self.ids)]

    def apply_model(self, m: Type) -> Type:
        known = {s.id for s in scalars(m)} | {column_id(e) for e in top(m)}
        if missing := [i for i in self.ids if i not in known]:
            raise ModelError(f"Variable not found: {', '.join(missing)}")
        if all(s.id in self.ids for s in scalars(m)):
            return m
        kept = self._kept(m)
        names = {s.id for e in kept for s in scalars(e)} | {column_id(e) for e in kept}
        if nested := [i for i in self.ids if i not in names]:
            raise ModelError(f"Nested variable not supported: {', '.join(nested)}")
        d = domain(m)
        own = [s for s in d if s in kept]
        ran = [e for e in range_(m) if e in kept]
        index = Index("_i" if not d or all(isinstance(s, Index) for s in d) and len(d) == 1 and d[0].id == "_i" else "_" + "_".join(s.id for s in d).lstrip("_"))
        if d and own and len(own) < len(d):
            raise ModelError("Part of a domain cannot be projected")
        if not isinstance(m, Function):
            return group(ran)
        if not ran:
            return Function(index, group(own))
        keep_id = m.range.id if isinstance(m.range, Tuple) and len(ran) > 1 else ""
        return Function(m.domain if own else index, group(ran, keep_id), m.id)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        new = self.apply_model(m)
        keep = columns(new)
        if ORD not in df.columns and isinstance(new, Function) and isinstance(new.domain, Index):
            # the place of a sample is a sort key, not a number: values of the domain that is gone
            d = domain(m)
            df = df.withColumn(ORD, col(d[0].id) if len(d) == 1 and not d[0].desc else F.struct(*[-col(s.id) if s.desc and s.kind in NUMERIC else col(s.id) for s in d]))
        return df.select(*[col(c) for c in keep], *([F.col(ORD)] if ORD in df.columns else []))


class Rename(Operator):
    def __init__(self, old: str, new: str) -> None:
        self.old, self.new = old, new

    def apply_model(self, m: Type) -> Type:
        if not any(s.id == self.old for s in scalars(m)):
            raise ModelError(f"Variable not found: {self.old}")
        from dataclasses import replace

        return change(m, lambda s: replace(s, id=self.new) if s.id == self.old else s)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        from funcframe.model import struct_type

        if self.old in df.columns:
            return df.withColumnRenamed(self.old, self.new)
        new = {f.name: f for f in struct_type(self.apply_model(m)).fields}
        old = {column_id(e): column_id(e2) for e, e2 in zip(top(m), top(self.apply_model(m)), strict=True)}
        return df.select(*[(col(c).cast(new[old[c]].dataType).alias(old[c]) if c in old and c in {column_id(e) for e in top(m) if isinstance(e, Function)} else col(c)) for c in df.columns])


def _plain(c: Column, op: str, v: Column, real: bool) -> Column:
    """Comparison by the numbers' partial order: NaN is not less, equal or greater, only unequal."""
    tests = {"=": c == v, "==": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}
    if not real:
        return tests[op]
    nan = F.isnan(c) | F.isnan(v)
    return (nan | tests[op]) if op == "!=" else (~nan & tests[op])


_FLIPPED = {">": "<", "<": ">", ">=": "<=", "<=": ">="}


class Selection(Filter):
    """Compares a variable with a value in its own order; with a bin width, compares the bin that starts at the variable."""

    def __init__(self, id: str, op: str, value: str) -> None:
        if op not in OPERATORS:
            raise ModelError(f"Unsupported operator: {op}")
        self.id, self.op, self.value = id, op, value

    @classmethod
    def parse(cls, text: str) -> Selection:
        from funcframe.plans import expressions

        got = expressions.parse(text)
        if len(got) != 1 or not isinstance(got[0], expressions.Selection):
            raise ModelError(f"Not a selection: {text}")
        return cls(got[0].id, got[0].op, got[0].value)

    def apply_model(self, m: Type) -> Type:
        self.where(m)
        return m

    def operands(self, s: Scalar) -> tuple[Column, Column, bool]:
        """The variable and the value as comparable columns, and whether they are real numbers."""
        if s.is_time:
            v = times.literal(s, unquoted(self.value))
            return (times.millis_of(s).cast("double") if times.is_text(s) else col(s.id).cast("double")), F.lit(v), True
        if s.kind in NUMERIC:
            number(self.value, "A selection")
            return col(s.id).cast("double"), F.lit(float(self.value)), True
        if s.kind == "boolean":
            if self.value.lower() not in ("true", "false"):
                raise ModelError(f"Invalid boolean: {self.value}")
            return col(s.id).cast("int"), F.lit(int(self.value.lower() == "true")), False
        return col(s.id), F.lit(unquoted(self.value)), False

    def where(self, m: Type) -> Column:
        if self.op in ("~", "=~", "!=~"):
            raise ModelError(f"Unsupported operator: {self.op}")
        s = find(m, self.id)
        if isinstance(s, Index):
            raise ModelError("An index has no values to select by")
        if s.kind in ("binary", "bigint", "bigdecimal"):  # values without an order are only ever unequal
            return F.lit(self.op == "!=") & col(s.id).isNotNull()
        c, v, real = self.operands(s)
        if "binWidth" in s.meta and real:
            w = float(s.meta["binWidth"])
            inside = (c <= v) & (v < c + w)
            by = {"=": inside, "==": inside, "!=": ~inside, ">": c + w > v, ">=": c + w > v, "<": c <= v, "<=": c <= v}
            return by[self.op]
        op = _FLIPPED.get(self.op, self.op) if s.desc and not (s.is_time and times.is_text(s)) else self.op
        return _plain(c, op, v, real)

    def __str__(self) -> str:
        return f"Selection({self.id} {self.op} {self.value})"


class Contains(Filter):
    """Keeps samples whose variable equals one of the values; null and NaN never do."""

    def __init__(self, id: str, *values: str) -> None:
        if not values:
            raise ModelError("contains needs a value")
        self.id, self.values = id, values

    def apply_model(self, m: Type) -> Type:
        self.where(m)
        return m

    def where(self, m: Type) -> Column:
        s = find(m, self.id)
        out = F.lit(False)
        for v in self.values:
            c, x, real = Selection(self.id, "=", v).operands(s)
            out = out | F.coalesce(_plain(c, "=", x, real), F.lit(False))
        return out


class RemoveVariables(Operator):
    """Takes variables out of the model and the samples."""

    def __init__(self, *ids: str) -> None:
        self.ids = ids

    def apply_model(self, m: Type) -> Type:
        rest = lambda items: [e for e in items if column_id(e) not in self.ids]
        return function(rest(domain(m)), rest(range_(m)))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.drop(*self.ids)


# Choosing by place


class Take(Operator, Taking):
    def __init__(self, n: int | str) -> None:
        self.n = max(0, integer(n, "take"))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.orderBy(*keys(df, m)).limit(self.n)


class Head(Take):
    def __init__(self) -> None:
        super().__init__(1)


class TakeRight(Operator, Taking):
    """The last samples, by a sort in reverse that Spark turns into a top-n of each partition."""

    def __init__(self, n: int | str) -> None:
        self.n = max(0, integer(n, "takeRight"))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.orderBy(*keys(df, m, reverse=True)).limit(self.n)


class Last(TakeRight):
    def __init__(self) -> None:
        super().__init__(1)


#: Up to so many samples, the key of the last one to leave out is found by a top-n; beyond, all are numbered.
MOST_BY_KEY = 100_000


def _behind(df: DataFrame, m: Type, n: int, reverse: bool) -> DataFrame:
    if n <= MOST_BY_KEY:
        return behind(df, order_parts(m, reverse, df.columns), n) if n else df
    return with_ordinal(df, keys(df, m, reverse=reverse), "__n").where(F.col("__n") >= n).drop("__n")


class Drop(Operator):
    """All but the first samples: rows behind the n-th in order, whatever partition they are in."""

    def __init__(self, n: int | str) -> None:
        self.n = max(0, integer(n, "drop"))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return _behind(df, m, self.n, False)


class Tail(Drop):
    def __init__(self) -> None:
        super().__init__(1)


class DropRight(Operator):
    def __init__(self, n: int | str) -> None:
        self.n = max(0, integer(n, "dropRight"))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return _behind(df, m, self.n, True)


class DropLast(DropRight):
    def __init__(self) -> None:
        super().__init__(1)


class Stride(Operator):
    """Samples 0, n, 2n, ..."""

    def __init__(self, *steps: int | str) -> None:
        self.steps = [integer(s, "stride") for s in steps]
        if len(steps) < 1 or self.steps[0] < 1:
            raise ModelError("stride needs a positive step")

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return with_ordinal(df, keys(df, m), "__n").where(F.col("__n") % self.steps[0] == 0).drop("__n")


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and issubclass(v, Operator)] + ["elements"]
