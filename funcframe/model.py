"""The functional data model: scalars, tuples and functions, and how they lie in a DataFrame.

A dataset's outer function is a DataFrame with a column for each scalar of domain and range. A function within the range
is one column, an array of structs. An index has no column; rows then carry their place in the hidden column ``ORD``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = "__ord"


class ModelError(ValueError):
    """A request that does not fit the model; raised before any job runs."""


#: Value types and their Spark types.
SPARK_TYPES = {
    "boolean": T.BooleanType(), "byte": T.ByteType(), "char": T.StringType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "binary": T.BinaryType(), "string": T.StringType(), "bigint": T.DecimalType(38, 0), "bigdecimal": T.DecimalType(38, 18),
}
INTEGRAL = {"byte", "short", "int", "long"}
NUMERIC = INTEGRAL | {"float", "double"}
IDENTIFIER = re.compile(r"(?!\d)[\w.]+\Z")


@dataclass(frozen=True)
class Scalar:
    """One variable. ``meta`` holds units, missingValue, fillValue, precision, order, binWidth and what else is known."""

    id: str
    type: str = "int"
    meta: dict = field(default_factory=dict, hash=False)
    is_time: bool = False

    def __post_init__(self) -> None:
        if not IDENTIFIER.match(self.id):
            raise ModelError(f"Invalid identifier: {self.id}")
        if self.type.lower() not in SPARK_TYPES:
            raise ModelError(f"Invalid type: {self.type}")
        m = self.meta
        if "fillValue" in m and m["fillValue"] in (None, "null"):
            raise ModelError("fillValue must not be null")
        if m.get("order", "asc") not in ("asc", "desc"):
            raise ModelError("order must be asc or desc")
        if "binWidth" in m and not float(m["binWidth"]) > 0:
            raise ModelError("binWidth must be positive")
        if "precision" in m and (int(m["precision"]) < 0 or self.kind not in ("float", "double", "bigdecimal")):
            raise ModelError("precision needs a real type and no negative number")

    @property
    def kind(self) -> str:
        return self.type.lower()

    @property
    def desc(self) -> bool:
        return self.meta.get("order") == "desc"

    @property
    def units(self) -> str | None:
        return self.meta.get("units")

    @property
    def spark(self) -> T.DataType:
        return SPARK_TYPES[self.kind]

    def with_meta(self, **changes: object) -> Scalar:
        return replace(self, meta={k: v for k, v in (self.meta | changes).items() if v is not None})

    def __str__(self) -> str:
        return self.id


@dataclass(frozen=True)
class Index(Scalar):
    """A domain variable without values."""

    type: str = "long"


@dataclass(frozen=True)
class Tuple:
    elements: tuple
    id: str = ""

    def __post_init__(self) -> None:
        ids = [e.id for e in self.elements if getattr(e, "id", "")]
        if len(self.elements) < 2 or len(set(ids)) < len(ids):
            raise ModelError("A tuple needs two elements or more, with distinct ids")

    def __str__(self) -> str:
        return (f"{self.id}: " if self.id else "") + "(" + ", ".join(map(str, self.elements)) + ")"


@dataclass(frozen=True)
class Function:
    domain: object
    range: object
    id: str = ""

    def __post_init__(self) -> None:
        if any(isinstance(e, Function) for e in elements(self.domain)):
            raise ModelError("A domain must not hold a function")
        if any(isinstance(e, Index) for e in elements(self.range)):
            raise ModelError("A range must not hold an index")

    def __str__(self) -> str:
        return (f"{self.id}: " if self.id else "") + f"{self.domain} -> {self.range}"


Type = Scalar | Tuple | Function


def elements(t: Type | None) -> list:
    """Scalars and functions of a type, tuples taken apart."""
    if t is None:
        return []
    return [x for e in t.elements for x in elements(e)] if isinstance(t, Tuple) else [t]


def group(items: list, id: str = "") -> Type | None:
    """One element as it is, several as a tuple."""
    return items[0] if len(items) == 1 else Tuple(tuple(items), id) if items else None


def domain(m: Type) -> list[Scalar]:
    return elements(m.domain) if isinstance(m, Function) else []


def range_(m: Type) -> list:
    return elements(m.range) if isinstance(m, Function) else elements(m)


def function(dom: list, ran: list, id: str = "", range_id: str = "") -> Type:
    """A function, or its bare range where there is no domain."""
    ran_t = group(ran, range_id)
    return Function(group(dom), ran_t, id) if dom else ran_t


def top(m: Type) -> list:
    """Scalars and functions that are columns."""
    return domain(m) + range_(m)


def scalars(t: Type | None) -> Iterator[Scalar]:
    for e in elements(t):
        if isinstance(e, Function):
            yield from scalars(e.domain)
            yield from scalars(e.range)
        else:
            yield e


def column_id(e: Type) -> str:
    """A function's column is named by its id, or by the ids of its scalars."""
    return e.id or "_".join(s.id for s in scalars(e)) if isinstance(e, Function) else e.id


def find(m: Type, id: str) -> Scalar:
    """A scalar that is a column of its own."""
    for e in top(m):
        if isinstance(e, Scalar) and e.id == id:
            return e
    if any(s.id == id for s in scalars(m)):
        raise ModelError(f"Nested variable not supported: {id}")
    raise ModelError(f"Variable not found: {id}")


def change(t: Type, f: Callable[[Scalar], Scalar]) -> Type:
    """The same type with each scalar changed."""
    if isinstance(t, Function):
        return replace(t, domain=change(t.domain, f), range=change(t.range, f))
    return replace(t, elements=tuple(change(e, f) for e in t.elements)) if isinstance(t, Tuple) else f(t)


def col(id: str) -> Column:
    """Ids may hold dots."""
    return F.col(f"`{id}`")


def columns(m: Type) -> list[str]:
    return [column_id(e) for e in top(m) if not isinstance(e, Index)]


def struct_type(m: Type) -> T.StructType:
    """The Spark schema that the model declares; nothing is inferred from data."""

    def one(e: Type) -> T.StructField:
        if isinstance(e, Function):
            inner = [one(x) for x in elements(e.domain) + elements(e.range) if not isinstance(x, Index)]
            return T.StructField(column_id(e), T.ArrayType(T.StructType(inner)))
        return T.StructField(e.id, e.spark, True, {k: str(v) for k, v in e.meta.items()})

    return T.StructType([one(e) for e in top(m) if not isinstance(e, Index)])


def order_parts(m: Type, reverse: bool = False, df_columns: list[str] = ()) -> list[tuple[Column, bool]]:
    """The keys that samples are sorted by, and whether they fall: the domain, or the hidden place where it has an index."""
    keys = [s for s in domain(m) if not isinstance(s, Index)]
    if not keys or any(isinstance(s, Index) for s in domain(m)) or ORD in df_columns:
        return [(F.col(ORD), reverse)]
    return [(col(s.id), s.desc != reverse) for s in keys]


def order(m: Type, reverse: bool = False, df_columns: list[str] = ()) -> list[Column]:
    return [c.desc() if falls else c for c, falls in order_parts(m, reverse, df_columns)]


_TOKEN = re.compile(r"\s*(->|[(),:]|[\w.]+)")


def parse(text: str) -> Type:
    """A model from its text form: ``(x, y) -> (a: double, b: string)``; types default to int."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ModelError(f"Failed to parse model: {text}")
        tokens.append(m[1])
        at = m.end()
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal at
        got = peek()
        if not got or want and got != want:
            raise ModelError(f"Failed to parse model: {text}")
        at += 1
        return got

    def atom() -> Type:
        if peek() == "(":
            take("(")
            items = [whole()]
            while peek() == ",":
                take(",")
                items.append(whole())
            take(")")
            return items[0] if len(items) == 1 else Tuple(tuple(items))
        id = take()
        if peek() == ":":
            take(":")
            return Index(id) if peek() == "index" and take() else Scalar(id, take())
        return Index(id) if id == "_i" else Scalar(id)

    def whole() -> Type:
        left = atom()
        if peek() == "->":
            take("->")
            return Function(left, whole())
        return left

    out = whole()
    if at < len(tokens):
        raise ModelError(f"Failed to parse model: {text}")
    return out
