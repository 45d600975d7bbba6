"""Currying, pivoting, transposing, completing, evaluating and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcframe.model import ORD, Function, ModelError, Scalar, Type, col, column_id, columns, domain, elements, function, group, range_
from funcframe.operators.base import Operator, integer, place
from funcframe.operators.choosing import Selection
from funcframe.operators.grouping import _samples


class Curry(Operator):
    """(a, b) -> c becomes a -> b -> c: the first n domain variables stay outside."""

    def __init__(self, n: int | str = 1) -> None:
        self.n = integer(n, "curry")

    def _outer(self, m: Type) -> int:
        if not 0 < self.n <= len(domain(m)):
            raise ModelError("curry does not fit the domain")
        return self.n

    def apply_model(self, m: Type) -> Type:
        n, d = self._outer(m), domain(m)
        return m if n == len(d) else Function(group(d[:n]), Function(group(d[n:]), m.range))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        n, d = self._outer(m), domain(m)
        outer = [col(s.id) for s in d[:n]]
        if n == len(d):
            return df.groupBy(*outer).agg(*[F.min_by(F.struct(col(c)), place(df, m))[c].alias(c) for c in map(column_id, range_(m))])
        inner = Function(group(d[n:]), m.range)
        return df.groupBy(*outer).agg(_samples(df, inner, columns(inner), F.struct(*[col(s.id) for s in d[n:]]) if ORD not in df.columns else F.col(ORD)).alias(column_id(inner)))


class CurryRight(Curry):
    """The last n domain variables go inside. Samples are in domain order, so equal outer values are one run."""

    def _outer(self, m: Type) -> int:
        if not 0 < self.n < len(domain(m)):
            raise ModelError("curryRight does not fit the domain")
        return len(domain(m)) - self.n


class Uncurry(Operator):
    """One nested function laid out flat; without one nothing changes."""

    def apply_model(self, m: Type) -> Type:
        nested = [e for e in range_(m) if isinstance(e, Function)]
        if not nested:
            return m
        inner = self.apply_model(nested[0])
        ran = [x for e in range_(m) for x in (elements(inner.range) if e is nested[0] else [e])]
        return function(domain(m) + elements(inner.domain), ran)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        nested = [e for e in range_(m) if isinstance(e, Function)]
        if not nested:
            return df
        f = nested[0]
        keep = [c for c in columns(m) if c != column_id(f)] + ([ORD] if ORD in df.columns else [])
        flat = df.select(*[col(c) for c in keep], F.posexplode(col(column_id(f))).alias("__pos", "__sample"))
        flat = flat.select(*[col(c) for c in keep], *([F.struct(ORD, "__pos").alias("__new")] if ORD in keep else []), "__sample.*")
        if ORD in keep:
            flat = flat.drop(ORD).withColumnRenamed("__new", ORD)
        new = function(domain(m) + elements(f.domain), [x for e in range_(m) for x in (elements(f.range) if e is f else [e])])
        flat = flat.select(*[col(c) for c in columns(new)], *([F.col(ORD)] if ORD in flat.columns else []))
        return Uncurry().apply(flat, new)


def _equals(key: Scalar, value: str) -> Callable[[Column], Column]:
    return lambda x: x[key.id] == F.lit(value).try_cast(key.spark)


class Pivot(Operator):
    """a -> b -> (c, d) becomes a -> (v0_c, v0_d, v1_c, ...) for given values of b; a missing one gives the fill value."""

    def __init__(self, values: tuple[str, ...] | list[str], ids: tuple[str, ...] | list[str]) -> None:
        self.values, self.ids = tuple(values), tuple(ids)
        if len(self.values) != len(self.ids) or not self.values:
            raise ModelError("pivot needs as many names as values")

    def _inner(self, m: Type) -> Function:
        nested = [e for e in range_(m) if isinstance(e, Function)]
        if len(nested) != 1 or len(elements(nested[0].domain)) != 1:
            raise ModelError("pivot needs a nested function of one variable")
        return nested[0]

    def apply_model(self, m: Type) -> Type:
        from dataclasses import replace

        f = self._inner(m)
        made = [replace(s, id=f"{v}_{s.id}") for v in self.ids for s in elements(f.range)]
        return function(domain(m), made)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        f = self._inner(m)
        key = elements(f.domain)[0]
        made = []
        for value, name in zip(self.values, self.ids, strict=True):
            hit = F.try_element_at(F.filter(col(column_id(f)), _equals(key, value)), F.lit(1))
            for s in elements(f.range):
                fill = s.meta.get("fillValue", s.meta.get("missingValue"))
                got = hit[s.id]
                made.append((F.coalesce(got, F.lit(fill).try_cast(s.spark)) if fill not in (None, "null") else got).alias(f"{name}_{s.id}"))
        return df.select(*[col(s.id) for s in domain(m)], *made)


class Transpose(Operator):
    """(x, y) -> a becomes (y, x) -> a, in the new order; of equal points the first stays."""

    def apply_model(self, m: Type) -> Type:
        d = domain(m)
        if len(d) != 2:
            raise ModelError("transpose needs a two-dimensional domain")
        return Function(group(d[::-1]), m.range)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        new = self.apply_model(m)
        names = [column_id(e) for e in range_(m)]
        sort = F.col(ORD) if ORD in df.columns else F.struct(*[col(c) for c in names])
        first = F.min_by(F.struct(*[col(c) for c in names]), sort).alias("__range")
        return df.groupBy(*[col(s.id) for s in domain(new)]).agg(first).select(*[col(s.id) for s in domain(new)], "__range.*")


class MakeCartesian(Operator):
    """Every combination of the values of each dimension; where there is no sample, fill values.

    The combinations are the result itself, so their number is what was asked for; they are made from distinct values.
    """

    def apply_model(self, m: Type) -> Type:
        if len(domain(m)) < 2:
            raise ModelError("makeCartesian needs two dimensions or more")
        return m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        d = domain(m)
        grid = df.select(col(d[0].id)).distinct()
        for s in d[1:]:
            grid = grid.crossJoin(df.select(col(s.id)).distinct())
        out = grid.join(df.withColumn("__found", F.lit(True)), [s.id for s in d], "left")
        fills = []
        for e in range_(m):
            fill = e.meta.get("fillValue", e.meta.get("missingValue")) if isinstance(e, Scalar) else None
            c = col(column_id(e))
            fills.append((F.when(F.col("__found"), c).otherwise(F.lit(fill).try_cast(e.spark)) if fill not in (None, "null") else c).alias(column_id(e)))
        return out.select(*[col(s.id) for s in d], *fills)


class Evaluation(Operator):
    """The samples at one value of a domain variable, without that variable."""

    def __init__(self, id: str, value: str) -> None:
        self.id, self.value = id, value

    def apply_model(self, m: Type) -> Type:
        if self.id not in [s.id for s in domain(m)]:
            raise ModelError(f"Not a domain variable: {self.id}")
        Selection(self.id, "=", self.value).where(m)
        return function([s for s in domain(m) if s.id != self.id], range_(m))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.where(Selection(self.id, "=", self.value).where(m)).drop(self.id)


class Resample(Operator):
    """The dataset at every point of a set (a DataFrame of domain columns); a point without a sample is an error."""

    def __init__(self, points: DataFrame) -> None:
        self.points = points

    def apply_model(self, m: Type) -> Type:
        return m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        ids = [s.id for s in domain(m)]
        if not ids:
            return self.points.crossJoin(df)  # a constant: one row
        names = [column_id(e) for e in range_(m)]
        out = self.points.select(*[col(i) for i in ids]).join(df.withColumn("__found", F.lit(True)), ids, "left")
        miss = F.raise_error(F.lit("No sample at a point of the set"))
        return out.select(*[col(i) for i in ids], *[F.when(F.col("__found"), col(c)).otherwise(miss).alias(c) for c in names])
