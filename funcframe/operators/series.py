"""Operators that look at neighbours in the order of samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funcframe.model import INTEGRAL, NUMERIC, Function, ModelError, Scalar, Type, col, column_id, find, range_
from funcframe.operators.base import Operator, keys, number, one_dimension
from funcframe.plans.sequence import BLOCK, with_neighbours, with_ordinal
from funcframe.scratch import materialise


class OnChange(Operator):
    """The first and last samples, and each whose value differs from the one before; NaN differs from everything."""

    def __init__(self, id: str) -> None:
        self.id = id

    def apply_model(self, m: Type) -> Type:
        find(m, self.id)
        return m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        s = find(m, self.id)
        # without a neighbour behind it a sample is the last
        rows = with_ordinal(df, keys(df, m), "__n")
        rows = with_neighbours(rows, "__n", {"__was": F.struct(col(s.id).alias("v"))}, {"__next": F.col("__n")})
        c, was = col(s.id), F.col("__was")["v"]
        same = c.eqNullSafe(was)
        if s.kind in ("float", "double"):
            same = same & ~F.isnan(F.coalesce(c, F.lit(0.0)))
        return rows.where(F.col("__was").isNull() | F.col("__next").isNull() | ~same).drop("__n", "__was", "__next")


class Steps:
    """What a run of values makes of the value kept before it.

    The first value no farther than ``delta`` from a start is kept, and what follows depends on that value alone. So a
    run is a list of pieces (low, high, last): starts that lie within ``delta`` of low to high end with ``last``, and the
    first piece that fits counts. A start that fits none stays. ``after_nan`` is the end for a start of NaN, or none at all.
    """

    def __init__(self, delta: float) -> None:
        self.delta = delta
        self.low: list[float] = []
        self.high: list[float] = []
        self.last: list[float] = []
        self.covered: list[tuple[float, float]] = []
        self.after_nan = math.nan

    @classmethod
    def of(cls, values: np.ndarray, delta: float) -> Steps:
        out, n = cls(delta), len(values)
        if not n:
            return out
        ends: dict[int, float] = {}

        def end(i: int) -> float:
            way = []
            while i not in ends:
                way.append(i)
                j = _next(values, i, delta)
                if j == n:
                    ends[i] = float(values[i])
                    break
                i = j
            for k in reversed(way):
                ends[k] = ends[i]
            return ends[way[0] if way else i]

        out.after_nan = end(0)
        seen: set[float] = set()
        for i in _new_starts(values, delta, out):
            v = float(values[i])
            if v not in seen and not (math.isnan(v) and any(map(math.isnan, seen))):
                seen.add(v)
                out.add(v, v, end(i))
        return out

    def add(self, low: float, high: float, last: float) -> None:
        if self.low and _same(self.last[-1], last) and low <= self.high[-1] + self.delta and high >= self.low[-1] - self.delta:
            self.low[-1], self.high[-1] = min(self.low[-1], low), max(self.high[-1], high)
        else:
            self.low.append(low)
            self.high.append(high)
            self.last.append(last)
        if math.isnan(low):
            self.covered = [(-math.inf, math.inf)]
            return
        # edges of what is covered are drawn in a little, so that rounding leaves a piece too many and never one too few
        a, b = low - self.delta, high + self.delta
        a, b = a + 1e-9 * abs(a), b - 1e-9 * abs(b)
        if a < b < math.inf and a > -math.inf:
            kept = []
            for x, y in self.covered:
                if y < a or x > b:
                    kept.append((x, y))
                else:
                    a, b = min(a, x), max(b, y)
            self.covered = sorted([*kept, (a, b)])

    def covers(self, low: float, high: float) -> bool:
        return any(x <= low - self.delta and high + self.delta <= y for x, y in self.covered)

    def __call__(self, start: float | None) -> float:
        if start is None or math.isnan(start):
            return self.after_nan
        for low, high, last in zip(self.low, self.high, self.last, strict=True):
            if not low - start > self.delta and not start - high > self.delta:
                return last
        return start

    def then(self, other: Steps) -> Steps:
        """This run and another behind it."""
        out = Steps(self.delta)
        out.after_nan = other(self.after_nan)
        for low, high, last in zip(self.low, self.high, self.last, strict=True):
            out.add(low, high, other(last))
        for low, high, last in zip(other.low, other.high, other.last, strict=True):
            if math.isnan(low) or not out.covers(low, high):
                out.add(low, high, last)
        return out


def _same(a: float, b: float) -> bool:
    return a == b or math.isnan(a) and math.isnan(b)


def _next(values: np.ndarray, i: int, delta: float) -> int:
    """The first place behind i whose value is kept after that at i; the number of values if there is none."""
    at, width = i + 1, 64
    while at < len(values):
        with np.errstate(invalid="ignore"):  # equal infinities
            near = ~(np.abs(values[at : at + width] - values[i]) > delta)
        if near.any():
            return at + int(near.argmax())
        at, width = at + width, min(width * 4, 1 << 14)
    return len(values)


def _new_starts(values: np.ndarray, delta: float, out: Steps) -> Iterator[int]:
    """Places in order whose values fit starts that no earlier one fits."""
    at, width = 0, 256
    while at < len(values):
        part = values[at : at + width]
        free = np.ones(len(part), dtype=bool)
        for x, y in out.covered:
            free &= ~((part - delta >= x) & (part + delta <= y))
        if not free.any():
            at, width = at + width, min(width * 2, 1 << 14)
            continue
        k = int(free.argmax())
        yield at + k
        at += k + 1
        width = 256


class MaxDelta(Operator):
    """Keeps the first sample and each that differs from the last kept one by no more than a limit.

    The rule runs through the samples with one number of state. Each block of the ordered samples is summed up as what it
    makes of any state (``Steps``), each group of blocks as what its blocks make one after the other; the driver goes from
    group to group, tasks from block to block, and one more pass marks the samples. So there is one pass over the samples
    to sum up and one to mark, whatever the values are.
    """

    #: Blocks of a group.
    GROUP = 1024

    def __init__(self, id: str, delta: float | str) -> None:
        self.id, self.delta = id, number(delta, "maxDelta")

    def apply_model(self, m: Type) -> Type:
        if find(m, self.id).kind not in NUMERIC:
            raise ModelError("maxDelta needs a numeric variable")
        return m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        delta, group = self.delta, self.GROUP
        rows = with_ordinal(df, keys(df, m), "__n")
        rows = materialise(rows.withColumn("__block", F.floor(F.col("__n") / BLOCK)), "blocks")
        values = rows.select("__block", "__n", F.coalesce(col(self.id).cast("double"), F.lit(float("nan"))).alias("v"))
        pieces = "low array<double>, high array<double>, last array<double>, after_nan double"

        def shown(s: Steps) -> dict:
            return {"low": [s.low], "high": [s.high], "last": [s.last], "after_nan": [s.after_nan]}

        def given(low, high, last, after_nan) -> Steps:
            s, real = Steps(delta), lambda v: math.nan if v is None else float(v)  # NaN comes back as null
            for piece in zip(low, high, last, strict=True):
                s.add(*map(real, piece))
            s.after_nan = real(after_nan)
            return s

        def sums(pdf: pd.DataFrame) -> pd.DataFrame:
            v = pdf.sort_values("__n")["v"].to_numpy()
            block = int(pdf["__block"].iloc[0])
            return pd.DataFrame({"__group": [block // group], "__block": [block]} | shown(Steps.of(v, delta)))

        def joined(pdf: pd.DataFrame) -> pd.DataFrame:
            out = None
            for r in pdf.sort_values("__block").itertuples(index=False):
                one = given(*r[2:])
                out = one if out is None else out.then(one)
            return pd.DataFrame({"__group": [int(pdf["__group"].iloc[0])]} | shown(out))

        def starts(pdf: pd.DataFrame) -> pd.DataFrame:
            start = None if pdf["known"].iloc[0] == 0 else float(pdf["start"].iloc[0])  # a null is NaN here
            blocks, known, held = [], [], []
            for r in pdf.sort_values("__block")[["__block", "low", "high", "last", "after_nan"]].itertuples(index=False):
                blocks.append(int(r[0]))
                known.append(int(start is not None))
                held.append(0.0 if start is None else start)
                start = given(*r[1:])(start)
            return pd.DataFrame({"__block": blocks, "known": known, "start": held})

        def marks(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__n")
            v = pdf["v"].to_numpy()
            last = None if pdf["known"].iloc[0] == 0 else float(pdf["start"].iloc[0])
            places = []
            at = 0 if last is None else _next(np.concatenate([[last], v]), 0, delta) - 1
            while at < len(v):
                places.append(at)
                at = _next(v, at, delta)
            return pd.DataFrame({"n": pdf["__n"].to_numpy()[places]})

        spark = df.sparkSession
        blocks = materialise(values.groupBy("__block").applyInPandas(sums, f"__group long, __block long, {pieces}"), "steps")
        # a row for each group, of BLOCK * GROUP samples; its pieces are as many as starts can be told apart
        groups = sorted(map(tuple, blocks.groupBy("__group").applyInPandas(joined, f"__group long, {pieces}").collect()))
        if not groups:
            return rows.drop("__n", "__block")
        begun, start = [], None
        for number_, *steps in groups:
            begun.append((number_, int(start is not None), 0.0 if start is None else float(start)))
            start = given(*steps)(start)
        first = spark.createDataFrame(begun, "__group long, known int, start double")
        known = blocks.join(F.broadcast(first), "__group").groupBy("__group").applyInPandas(starts, "__block long, known int, start double")
        kept = values.join(known, "__block").groupBy("__block").applyInPandas(marks, "n long")
        return rows.join(kept.select(F.col("n").alias("__n")), "__n", "left_semi").drop("__n", "__block")


class Interpolate(Operator):
    """The dataset at points of its domain (a DataFrame of the domain's column): ``none`` takes equal samples alone,
    ``floor`` the sample before, ``nearest`` the nearer of two (the later of equal ones), ``linear`` the line between them.

    A point that a rule has no value for is an error; nothing is extrapolated. Points and samples are numbered together, so
    each block finds the sample before its points, and what a block starts with is one row for each block.
    """

    NAMES = {"none": "none", "floor": "floor", "nearest": "nearest", "near": "nearest", "linear": "linear"}

    def __init__(self, points: DataFrame, interpolation: str) -> None:
        if interpolation.lower() not in self.NAMES:
            raise ModelError(f"Unsupported interpolation: {interpolation}")
        self.points, self.interpolation = points, self.NAMES[interpolation.lower()]

    def apply_model(self, m: Type) -> Type:
        d = one_dimension(m, "Interpolation")
        if self.interpolation in ("nearest", "linear") and d.kind not in NUMERIC:
            raise ModelError("Interpolation between samples needs a numeric domain")
        if self.interpolation == "linear" and any(not isinstance(e, Scalar) or e.kind not in ("float", "double") for e in range_(m)):
            raise ModelError("Linear interpolation needs a real range")
        return m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        d = one_dimension(m, "Interpolation")
        names = [column_id(e) for e in range_(m)]
        own = F.struct(col(d.id).alias("at"), *[col(c) for c in names])
        s = with_neighbours(with_ordinal(df, keys(df, m), "__n"), "__n", {}, {"__next": own})
        s = s.select(col(d.id).alias("__x"), F.struct(own.alias("a"), F.col("__next").alias("b")).alias("__s"))
        both = s.unionByName(self.points.select(col(d.id).cast(d.spark).alias("__x")), allowMissingColumns=True)
        x = F.col("__x").desc() if d.desc else F.col("__x")
        both = with_ordinal(both, [x, F.col("__s").isNull()], "__n").withColumn("__block", F.floor(F.col("__n") / BLOCK))
        ends = both.where("__s IS NOT NULL").groupBy("__block").agg(F.max_by("__s", "__n").alias("__end"))
        blocks = both.groupBy("__block").agg(F.lit(0).alias("__zero")).join(ends, "__block", "left")
        carried = blocks.select("__block", F.last("__end", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
        within = F.last("__s", ignorenulls=True).over(Window.partitionBy("__block").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("__here", within).where("__s IS NULL").join(carried, "__block").withColumn("__f", F.coalesce("__here", "__carry"))
        a, b = F.col("__f")["a"], F.col("__f")["b"]
        point, equal = F.col("__x"), F.col("__x") == a["at"]
        fails = F.raise_error(F.lit("Interpolation has no sample for a point"))
        made = []
        for e in range_(m):
            c = column_id(e)
            if self.interpolation in ("none", "floor"):
                v = F.when(equal | F.lit(self.interpolation == "floor") & a.isNotNull(), a[c])
            else:
                near, far = F.abs(point.cast("double") - a["at"].cast("double")), F.abs(b["at"].cast("double") - point.cast("double"))
                between = F.when(far <= near, b[c]).otherwise(a[c]) if self.interpolation == "nearest" else (a[c] + (b[c] - a[c]) * near / (near + far)).cast(e.spark)
                v = F.when(equal, a[c]).when(b.isNotNull(), between)
            known = equal | (a.isNotNull() & F.lit(self.interpolation == "floor")) | (b.isNotNull() & F.lit(self.interpolation in ("nearest", "linear")))
            made.append(F.when(F.coalesce(known, F.lit(False)), v).otherwise(fails).alias(c))
        return found.select(point.alias(d.id), *made)


class MaxGap(Operator):
    """Puts samples into gaps larger than a size, that far apart, with values by ``floor``, ``nearest`` or ``linear``."""

    NAMES = {"floor": "floor", "nearest": "nearest", "near": "nearest", "linear": "linear"}

    def __init__(self, size: float | str, interpolation: str) -> None:
        self.size = number(size, "maxGap")
        if not self.size > 0:
            raise ModelError("maxGap needs a positive size")
        if interpolation.lower() not in self.NAMES:
            raise ModelError(f"Unsupported interpolation: {interpolation}")
        self.interpolation = self.NAMES[interpolation.lower()]

    def apply_model(self, m: Type) -> Type:
        d = one_dimension(m, "maxGap")
        if d.kind not in NUMERIC:
            raise ModelError("maxGap needs a numeric domain")
        if d.kind in INTEGRAL and self.size < 1:
            raise ModelError("A gap of whole numbers cannot be smaller than one")
        if self.interpolation == "linear" and any(not isinstance(e, Scalar) or e.kind not in ("float", "double") for e in range_(m)):
            raise ModelError("Linear interpolation needs a real range")
        return m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        d = one_dimension(m, "maxGap")
        size = float(int(self.size)) if d.kind in INTEGRAL else self.size
        names = [column_id(e) for e in range_(m)]
        rows = with_ordinal(df, keys(df, m), "__n")
        rows = with_neighbours(rows, "__n", {}, {"__next": F.struct(col(d.id).cast("double").alias("at"), F.struct(*[col(c) for c in names]).alias("v"))})
        x, end = col(d.id).cast("double"), F.col("__next")["at"]
        gap = F.abs(end - x)
        extra = F.when(gap > self.size, F.ceil(gap / size) - 1).otherwise(0)
        rows = rows.withColumn("__extra", F.coalesce(extra, F.lit(0))).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__extra").cast("long"))))
        i = F.col("__i")
        new_x = x + F.signum(end - x) * i * size
        made = []
        for e in range_(m):
            c, after = col(column_id(e)), F.col("__next")["v"][column_id(e)]
            if self.interpolation == "floor":
                v = c
            elif self.interpolation == "nearest":  # by distance to the sample put in before: only the last one is nearer to the end
                v = F.when(i == F.col("__extra"), after).otherwise(c)
            else:
                v = (c + (after - c) * ((new_x - x) / (end - x))).cast(e.spark)
            made.append(F.when(i == 0, c).otherwise(v).alias(column_id(e)))
        at = F.when(i == 0, col(d.id)).otherwise(new_x.cast(d.spark)).alias(d.id)
        return rows.select(at, *made)




__all__ = ["Function", "Interpolate", "MaxDelta", "MaxGap", "OnChange"]
