"""Appending datasets and looking values up in another dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funcframe.model import ORD, Function, ModelError, Type, col, column_id, columns, domain, elements, function, range_, scalars
from funcframe.operators.base import Operator


class Computed:
    """A function known by a formula: ``compute`` makes range columns of domain columns."""

    def __init__(self, model: Function, compute) -> None:
        self.model, self.compute = model, compute

    def columns(self, args: list[Column]) -> list[Column]:
        got = self.compute(*args)
        return list(got) if isinstance(got, (list, tuple)) else [got]


class Known:
    """A function known by its samples; of samples with one domain value the first counts."""

    def __init__(self, model: Function, df: DataFrame) -> None:
        self.model, self.df = model, df

    def lookup(self, names: list[str]) -> DataFrame:
        """Domain columns under ``names``, and ``__value``: a struct of the range."""
        d = [s.id for s in domain(self.model)]
        r = [column_id(e) for e in range_(self.model)]
        value = F.struct(*[col(c) for c in r])
        sort = F.col(ORD) if ORD in self.df.columns else value
        return self.df.groupBy(*[col(i).alias(n) for i, n in zip(d, names, strict=True)]).agg(F.min_by(value, sort).alias("__value"))


def append(parts: list[tuple[Type, DataFrame]]) -> tuple[Type, DataFrame]:
    """Samples of the first, then of the next; the first model holds. Its range and domain give the columns by place.

    The union has a hidden place of (part, place in the part), for operators that need the order of samples.
    """
    model = parts[0][0]
    names = columns(model)
    made = []
    for i, (m, df) in enumerate(parts):
        own = F.struct(*[col(s.id) for s in domain(m)]) if ORD not in df.columns else F.col(ORD)
        made.append(df.select(*[col(c).alias(n) for c, n in zip(columns(m), names, strict=True)], F.struct(F.lit(i).alias("part"), own.alias("at")).alias(ORD)))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return model, out


class Append(Operator):
    def __init__(self, model: Type, df: DataFrame) -> None:
        self.model, self.df = model, df

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return append([(m, df), (self.model, self.df)])[1]


class Composition(Operator):
    """The range becomes what another function has for it; a value that it lacks is an error.

    Spark picks the join: by broadcast for a small table by its statistics, else by a shuffle.
    """

    def __init__(self, other: Known | Computed) -> None:
        self.other = other

    def apply_model(self, m: Type) -> Type:
        if len(range_(m)) != len(domain(self.other.model)):
            raise ModelError("The range is not the other function's domain")
        return Function(m.domain, self.other.model.range) if isinstance(m, Function) else self.other.model.range

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        own = [column_id(e) for e in range_(m)]
        names = [column_id(e) for e in elements(self.other.model.range)]
        keep = [col(s.id) for s in domain(m) if s.id in df.columns] + ([F.col(ORD)] if ORD in df.columns else [])
        if isinstance(self.other, Computed):
            return df.select(*keep, *[c.alias(n) for c, n in zip(self.other.columns([col(c) for c in own]), names, strict=True)])
        keys = [f"__k{i}" for i in range(len(own))]
        table = self.other.lookup(keys).withColumn("__found", F.lit(True))
        joined = df.withColumns({k: col(c) for k, c in zip(keys, own, strict=True)}).join(table, keys, "left")
        miss = F.raise_error(F.lit("No value for a sample"))
        return joined.select(*keep, *[F.when(F.col("__found"), F.col("__value")[n]).otherwise(miss).alias(n) for n in names])


class Substitution(Operator):
    """Variables that are another function's domain are replaced by its range; samples that it lacks are dropped."""

    def __init__(self, other: Known | Computed) -> None:
        self.other = other

    def _ids(self) -> list[str]:
        return [s.id for s in domain(self.other.model)]

    def _replace(self, items: list) -> list | None:
        ids, n = self._ids(), len(self._ids())
        for i in range(len(items) - n + 1):
            if [getattr(e, "id", None) for e in items[i : i + n]] == ids:
                return [*items[:i], *elements(self.other.model.range), *items[i + n :]]
        return None

    def apply_model(self, m: Type) -> Type:
        if (d := self._replace(domain(m))) is not None:
            return function(d, range_(m))
        if (r := self._replace(range_(m))) is not None:
            return function(domain(m), r)
        for e in range_(m):
            if isinstance(e, Function) and any(s.id in self._ids() for s in scalars(e)):
                return function(domain(m), [self.apply_model(x) if x is e else x for x in range_(m)])
        raise ModelError("Variables not found: " + ", ".join(self._ids()))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        new = self.apply_model(m)
        ids = self._ids()
        names = [column_id(e) for e in elements(self.other.model.range)]
        if all(i in df.columns for i in ids):
            if isinstance(self.other, Computed):
                made = self.other.columns([col(i) for i in ids])
                out = df.withColumns({f"__v{i}": c for i, c in enumerate(made)}).drop(*ids)
            else:
                out = df.join(self.other.lookup(ids), ids).select("*", *[F.col("__value")[n].alias(f"__v{i}") for i, n in enumerate(names)]).drop(*ids, "__value")
            for i, n in enumerate(names):
                out = out.withColumnRenamed(f"__v{i}", n)
            return out.select(*[col(c) for c in columns(new)], *([F.col(ORD)] if ORD in df.columns else []))
        f_old = next(e for e in range_(m) if isinstance(e, Function))
        f_new = next(e for e in range_(new) if isinstance(e, Function))
        keep = [c for c in columns(m) if c != column_id(f_old)]
        held = df.withColumn("__row", F.monotonically_increasing_id())
        flat = held.select("__row", *[col(c) for c in keep], F.posexplode_outer(col(column_id(f_old))).alias("__pos", "__sample")).select("*", "__sample.*").drop("__sample")
        inner = Substitution(self.other)
        body = inner.apply(flat.withColumn("__rest", F.struct("__row", "__pos", *[col(c) for c in keep])).select("__rest", *[col(c) for c in columns(f_old)]).withColumnRenamed("__rest", ORD), f_old)
        sample = F.struct(*[col(c) for c in columns(f_new)])
        grouped = body.groupBy(F.col(ORD)["__row"].alias("__row")).agg(F.array_sort(F.collect_list(F.struct(F.col(ORD)["__pos"].alias("at"), sample.alias("s")))).alias("__f"))
        return grouped.join(held.select("__row", *[col(c) for c in keep]), "__row").select(*[col(c) for c in keep], F.transform("__f", lambda x: x["s"]).alias(column_id(f_new)))
