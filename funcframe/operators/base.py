"""What all operators share. ``apply_model`` is pure and runs first; ``apply`` builds the DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from funcframe.model import ORD, Function, Index, ModelError, Scalar, Type, domain, find, order


class Operator:
    """One step of a request. Subclasses say what becomes of the model and of the samples."""

    def apply_model(self, m: Type) -> Type:
        return m

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        raise NotImplementedError

    def __str__(self) -> str:
        args = ", ".join(str(v) for v in vars(self).values())
        return f"{type(self).__name__}({args})"


class Filter(Operator):
    """Keeps the samples for which a condition is true; null counts as false. Takes a Column or a function of the model."""

    def __init__(self, condition: Column | Callable[[Type], Column]) -> None:
        self.condition = condition

    def where(self, m: Type) -> Column:
        return self.condition(m) if callable(self.condition) and not isinstance(self.condition, Column) else self.condition

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return df.where(self.where(m))


class MapSamples(Operator):
    """Any change of samples, given as functions of model and DataFrame (also one that makes many rows of one)."""

    def __init__(self, samples: Callable[[DataFrame], DataFrame], model: Callable[[Type], Type] = lambda m: m) -> None:
        self.samples, self.model = samples, model

    def apply_model(self, m: Type) -> Type:
        return self.model(m)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        return self.samples(df)


class MapRange(MapSamples):
    """A change of range values alone; the expression should ``raise_error`` where it must not be computed."""


class Aggregation(Operator):
    """All samples to one without a domain."""


class Taking:
    """Marks operators that choose samples by place alone and may run on each part of a union and again on the whole."""


def ordered(df: DataFrame, m: Type, reverse: bool = False) -> DataFrame:
    return df.orderBy(*order(m, reverse, df.columns))


def keys(df: DataFrame, m: Type, reverse: bool = False) -> list[Column]:
    return order(m, reverse, df.columns)


def place(df: DataFrame, m: Type) -> Column:
    """Something to sort by within a group, as a column of the sample."""
    from pyspark.sql import functions as F

    return F.struct(*keys(df, m)) if ORD not in df.columns else F.col(ORD)


def one_dimension(m: Type, what: str) -> Scalar:
    d = domain(m)
    if not isinstance(m, Function) or len(d) != 1 or isinstance(d[0], Index):
        raise ModelError(f"{what} needs a one-dimensional domain with values")
    return d[0]


def integer(text: object, what: str) -> int:
    try:
        return int(str(text))
    except ValueError:
        raise ModelError(f"{what} needs an integer: {text}") from None


def number(text: object, what: str) -> float:
    try:
        return float(str(text))
    except ValueError:
        raise ModelError(f"{what} needs a number: {text}") from None


def numeric_range(m: Type, what: str) -> Scalar:
    from funcframe.model import NUMERIC, range_

    r = range_(m)
    if len(r) != 1 or not isinstance(r[0], Scalar) or r[0].kind not in NUMERIC:
        raise ModelError(f"{what} needs a single numeric range variable")
    return r[0]


__all__ = ["Aggregation", "Filter", "MapRange", "MapSamples", "Operator", "Taking", "find", "integer", "keys", "number", "numeric_range", "one_dimension", "ordered", "place"]
