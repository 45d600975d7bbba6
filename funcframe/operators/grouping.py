"""Aggregations, alone and by group, bin or width."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcframe.model import INTEGRAL, NUMERIC, ORD, Function, Index, ModelError, Scalar, Tuple, Type, col, column_id, columns, domain, elements, find, function, group, range_, scalars
from funcframe.operators.base import Aggregation, Operator, keys, number, numeric_range, one_dimension, place


def _samples(df: DataFrame, m: Type, names: list[str], sort: Column) -> Column:
    """The group's samples in order, as an array of structs of ``names``."""
    lists = F.array_sort(F.collect_list(F.struct(sort.alias("at"), F.struct(*[col(c) for c in names]).alias("sample"))))
    return F.transform(lists, lambda x: x["sample"])


def _first(df: DataFrame, m: Type, name: str) -> Column:
    return F.min_by(F.struct(col(name)), place(df, m))[name]


class Count(Aggregation):
    def apply_model(self, m: Type) -> Type:
        return Scalar("count", "long")

    def columns(self, df: DataFrame, m: Type) -> list[Column]:
        return [F.count(F.lit(1)).alias("count")]

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.agg(*self.columns(df, m))


class Stats(Aggregation):
    """mean, min, max and count of the one numeric range variable. NaN is counted and makes the others NaN; nothing gives nulls."""

    def apply_model(self, m: Type) -> Type:
        s = numeric_range(m, "stats")
        return Tuple((Scalar("mean", "double"), Scalar("min", "double"), Scalar("max", "double"), Scalar("count", "long")), s.id)

    def columns(self, df: DataFrame, m: Type) -> list[Column]:
        x = col(numeric_range(m, "stats").id).cast("double")
        nan = F.lit(float("nan"))
        low = F.when(F.max(F.isnan(x).cast("int")) == 1, nan).otherwise(F.min(x))
        return [F.avg(x).alias("mean"), low.alias("min"), F.max(x).alias("max"), F.count(F.lit(1)).alias("count")]

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.agg(*self.columns(df, m))


class Sum(Aggregation):
    """Each range variable's sum: whole numbers as long (wrapping), others as double, NaN for what is no number."""

    def apply_model(self, m: Type) -> Type:
        if any(isinstance(e, Function) for e in range_(m)):
            raise ModelError("A nested function cannot be summed")
        return group([Scalar(e.id, "long" if e.kind in INTEGRAL else "double", {} if e.kind in NUMERIC else {"fillValue": "NaN"}) for e in range_(m)])

    def columns(self, df: DataFrame, m: Type) -> list[Column]:
        out = []
        for s in range_(m):
            if s.kind in INTEGRAL:
                whole = F.sum(col(s.id).cast("decimal(20,0)"))
                half, full = (F.lit(str(2**k)).cast("decimal(21,0)") for k in (63, 64))
                c = (F.pmod(whole + half, full) - half).cast("long")
            else:
                c = F.sum(col(s.id).cast("double")) if s.kind in NUMERIC else F.first(F.lit(float("nan")))
            out.append(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("Cannot sum an empty dataset"))).otherwise(c).alias(s.id))
        return out

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.agg(*self.columns(df, m))


class Default(Aggregation):
    """Within a group: its samples as a nested function, or the first sample's range where there is no domain left."""

    def apply_model(self, m: Type) -> Type:
        return m

    def columns(self, df: DataFrame, m: Type) -> list[Column]:
        if isinstance(m, Function):
            return [_samples(df, m, columns(m), place(df, m)).alias(column_id(m))]
        return [_first(df, m, column_id(e)).alias(column_id(e)) for e in range_(m)]

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.agg(*self.columns(df, m))


class First(Default):
    """The range of the first sample; nulls of an empty dataset."""

    def apply_model(self, m: Type) -> Type:
        return group(range_(m))

    def columns(self, df: DataFrame, m: Type) -> list[Column]:
        return [_first(df, m, column_id(e)).alias(column_id(e)) for e in range_(m)]


class Nearest(First):
    """The range of the sample nearest to a point of the domain, the first of several."""

    def __init__(self, *point: float) -> None:
        self.point = point

    def columns(self, df: DataFrame, m: Type) -> list[Column]:
        d = domain(m)
        if len(d) != len(self.point) or any(s.kind not in NUMERIC for s in d):
            raise ModelError("The point does not fit the domain")
        far = sum(((col(s.id).cast("double") - float(p)) ** 2 for s, p in zip(d, self.point, strict=True)), F.lit(0.0))
        return [F.min_by(F.struct(col(column_id(e))), F.struct(F.sqrt(far), place(df, m)))[column_id(e)].alias(column_id(e)) for e in range_(m)]


class CountBy(Operator):
    """The number of samples for each combination of values, in their order."""

    def __init__(self, *ids: str) -> None:
        if not ids:
            raise ModelError("countBy needs a variable")
        self.ids = ids

    def apply_model(self, m: Type) -> Type:
        return Function(group([find(m, i) for i in self.ids]), Scalar("count", "long"))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.groupBy(*[col(i) for i in self.ids]).agg(F.count(F.lit(1)).alias("count"))


class GroupBy(Operator):
    """New domain variables; what else there is becomes a nested function, or the first sample if no domain is left."""

    def __init__(self, *ids: str, aggregation: Aggregation | None = None) -> None:
        if not ids:
            raise ModelError("groupBy needs a variable")
        self.ids, self.aggregation = ids, aggregation or Default()

    def _inner(self, m: Type) -> Type:
        d = [s for s in domain(m) if s.id not in self.ids]
        r = [e for e in range_(m) if column_id(e) not in self.ids]
        if not r and d:
            return Function(Index("_i"), group(d))
        if not r:
            raise ModelError("groupBy leaves nothing")
        return function(d, r)

    def apply_model(self, m: Type) -> Type:
        return Function(group([find(m, i) for i in self.ids]), self.aggregation.apply_model(self._inner(m)))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        inner = self._inner(m)
        if not isinstance(inner, Function) or type(self.aggregation) in (Default, First):
            sort = place(df, m)
            if isinstance(inner, Function) and type(self.aggregation) is Default:
                made = [_samples(df, inner, columns(inner), sort).alias(column_id(inner))]
            else:
                made = [F.min_by(F.struct(col(column_id(e))), sort)[column_id(e)].alias(column_id(e)) for e in range_(inner)]
        else:
            made = self.aggregation.columns(df, inner)
        return df.where(" AND ".join(f"`{i}` IS NOT NULL" for i in self.ids)).groupBy(*[col(i) for i in self.ids]).agg(*made)


class GroupByBinWidth(Operator):
    """Bins of equal width over a numeric domain; empty bins are absent. Samples are in domain order, so a bin is one run."""

    def __init__(self, width: float | str, aggregation: str | Aggregation | None = None) -> None:
        self.width = number(width, "groupByBinWidth")
        if not self.width > 0 or math.isinf(self.width):
            raise ModelError("The bin width must be positive")
        known: dict[str, Callable[[], Aggregation]] = {"count": Count, "stats": Stats}
        if isinstance(aggregation, str):
            if aggregation not in known:
                raise ModelError(f"Unknown aggregation: {aggregation}")
            aggregation = known[aggregation]()
        self.aggregation = aggregation or Default()

    def apply_model(self, m: Type) -> Type:
        d = one_dimension(m, "groupByBinWidth")
        if d.kind not in NUMERIC:
            raise ModelError("groupByBinWidth needs a numeric domain")
        return Function(Scalar(d.id, "double", d.meta | {"binWidth": self.width}, d.is_time), self.aggregation.apply_model(m))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        d = one_dimension(m, "groupByBinWidth")
        low = F.floor(col(d.id).cast("double") / self.width).cast("double") * self.width
        made = self.aggregation.columns(df, m)
        return df.groupBy(low.alias("__bin")).agg(*made).withColumnRenamed("__bin", d.id)


class BinSet:
    """``count`` bins of width ``step`` from ``start``; a value's bin is cut toward zero, as in a cast."""

    def __init__(self, start: float, step: float, count: int) -> None:
        self.start, self.step, self.count = start, step, count

    def index(self, c: Column) -> Column:
        i = ((c.cast("double") - self.start) / self.step).cast("int")
        return F.when((i >= 0) & (i < self.count), i)


class GroupByBin(Operator):
    """Bins of a set, all of them present; an empty one has no sample, a count of zero or nulls. Samples outside are dropped."""

    def __init__(self, bins: BinSet, aggregation: Aggregation | None = None) -> None:
        self.bins, self.aggregation = bins, aggregation or Default()

    def apply_model(self, m: Type) -> Type:
        d = one_dimension(m, "groupByBin")
        return Function(Scalar(d.id, "double", d.meta), self.aggregation.apply_model(m))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        d = one_dimension(m, "groupByBin")
        b = self.bins
        full = df.withColumn("__bin", b.index(col(d.id))).where("__bin IS NOT NULL").groupBy("__bin").agg(*self.aggregation.columns(df, m))
        names = [c for c in full.columns if c != "__bin"]
        if isinstance(self.aggregation, (Count, Stats)):
            full = full.withColumnRenamed("count", "__count")
        if d.id in names:
            full = full.withColumnRenamed(d.id, "__own")
        every = df.sparkSession.range(b.count).select(F.col("id").cast("int").alias("__bin"), (F.lit(float(b.start)) + F.col("id") * float(b.step)).alias(d.id))
        out = every.join(full, "__bin", "left")
        if "__count" in out.columns:
            out = out.withColumn("count", F.coalesce("__count", F.lit(0).cast("long")))
        return out.select(col(d.id), *[col(c) if c != d.id else F.col("__own").alias(c) for c in names])


def _adds(name: str, kind: str) -> Callable[[Column, Column], Column]:
    return lambda total, x: (total + x[name].cast(kind)).cast(kind)


class SumIntegration(Operator):
    """Sums the innermost function over its one domain variable."""

    def __init__(self, id: str) -> None:
        self.id = id

    def _parts(self, m: Type) -> tuple[Function | None, list[Scalar]]:
        outer, f = None, m
        nested = [e for e in range_(m) if isinstance(e, Function)]
        if nested:
            outer, f = m, nested[0]
        d = elements(f.domain) if isinstance(f, Function) else []
        if len(d) != 1 or d[0].id != self.id:
            raise ModelError(f"{self.id} is not the domain of the innermost function")
        r = elements(f.range)
        if any(not isinstance(s, Scalar) or s.kind not in NUMERIC for s in r):
            raise ModelError("Only numeric ranges can be integrated")
        return outer, r

    def apply_model(self, m: Type) -> Type:
        outer, r = self._parts(m)
        new = [Scalar(s.id, "long" if s.kind in INTEGRAL else "double") for s in r]
        return function(domain(outer), [n for e in range_(outer) for n in (new if isinstance(e, Function) else [e])]) if outer else group(new)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        outer, r = self._parts(m)
        if outer is None:
            return df.agg(*Sum().columns(df, m))
        f = next(e for e in range_(outer) if isinstance(e, Function))
        made = []
        for s in r:
            kind = "long" if s.kind in INTEGRAL else "double"
            made.append(F.aggregate(col(column_id(f)), F.lit(0).cast(kind), _adds(s.id, kind)).alias(s.id))
        out = [x for e in range_(outer) for x in (made if isinstance(e, Function) else [col(column_id(e))])]
        return df.select(*[col(s.id) for s in domain(outer) if not isinstance(s, Index)], *out, *([F.col(ORD)] if ORD in df.columns else []))


__all__ = ["BinSet", "Count", "CountBy", "Default", "First", "GroupBy", "GroupByBin", "GroupByBinWidth", "Nearest", "Stats", "Sum", "SumIntegration", "keys", "scalars"]
