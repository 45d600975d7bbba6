"""Text sources as DataFrame plans: delimited, columnar, by pattern, by format, by position, and matrices."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.model import ORD, Function, Index, ModelError, Scalar, Type, col, domain, elements, range_
from funcframe.plans.sequence import with_ordinal


def parsed(c: Column, s: Scalar) -> Column:
    """A text as the scalar's type by strict rules; the fill value where it does not parse, else null."""
    k = s.kind
    if k in ("byte", "short", "int", "long", "bigint"):
        v = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast(s.spark))
    elif k in ("float", "double"):
        number = r"^[\x00-\x20]*[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?)[\x00-\x20]*$"
        v = F.when(c.rlike(number), F.regexp_replace(F.trim(c), "(?<=[0-9.])[fFdD]$", "").try_cast(s.spark))
    elif k == "boolean":
        v = F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true")
    elif k == "char":
        v = F.when(F.length(c) > 0, F.substring(c, 1, 1))
    elif k == "bigdecimal":
        v = c.try_cast(s.spark)
    elif k == "binary":
        v = F.lit(None).cast("binary")
    else:
        v = c
    fill = s.meta.get("fillValue")
    return F.coalesce(v, F.lit(str(fill)).try_cast(s.spark)) if fill is not None else v


@dataclass(frozen=True)
class TextAdapter:
    """Lines to samples. Steps in order: skip lines, seek the marker, drop comments and empty lines, join lines to
    records, split. A record that does not fit the model is dropped.

    Without line numbers to mind, files are read in parallel and keep their order by file offset.
    """

    model: Type
    delimiter: str = ","
    skip_lines: int = 0
    lines_per_record: int = 1
    data_marker: str | None = None
    comment: str | None = None

    def fields(self, line: Column) -> Column:
        """The record's texts, as an array."""
        return F.split(F.trim(line), self.delimiter, -1)

    def read(self, spark: SparkSession, *paths: str) -> DataFrame:
        held = None
        for i, p in enumerate(paths):
            one = self._lines(spark, p).withColumn("file", F.lit(i))
            held = one if held is None else held.unionByName(one)
        if held is None:
            raise ModelError("No path to read")
        place = F.struct("file", "n")
        return self.samples(held.select("value", place.alias(ORD)))

    def _lines(self, spark: SparkSession, path: str) -> DataFrame:
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
        if self.skip_lines:
            lines = with_ordinal(lines, [F.col("n")], "__i").where(F.col("__i") >= self.skip_lines).drop("__i")
        if self.data_marker:
            at = lines.where(F.col("value").rlike(self.data_marker)).agg(F.min("n").alias("at"))
            lines = lines.crossJoin(F.broadcast(at)).where("n > at").drop("at")  # one row
        if self.comment:
            lines = lines.where(~F.col("value").startswith(self.comment))
        lines = lines.where(F.length(F.trim("value")) > 0)
        if self.lines_per_record > 1:
            k = self.lines_per_record
            numbered = with_ordinal(lines, [F.col("n")], "__i").withColumn("r", F.floor(F.col("__i") / k))
            whole = numbered.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("ls")).where(F.size("ls") == k)
            lines = whole.select(F.array_join(F.transform("ls", lambda x: x["value"]), self._joint()).alias("value"), F.col("r").alias("n"))
        return lines

    def _joint(self) -> str:
        return " " if self.delimiter.startswith("\\s") else self.delimiter

    def samples(self, lines: DataFrame) -> DataFrame:
        """Samples of rows (value, ORD)."""
        d = [s for s in domain(self.model) if not isinstance(s, Index)]
        r = range_(self.model)
        if any(isinstance(e, Function) for e in r):
            raise ModelError("A text record holds no nested function")
        want = [*d, *r]
        rows = lines.select(self.fields(F.col("value")).alias("f"), ORD).where(F.size("f") == len(want))
        rows = rows.select(*[parsed(F.get("f", F.lit(i)), s).alias(s.id) for i, s in enumerate(want)], ORD)
        need = [s for s in want if s.meta.get("missingValue") != "null"]
        rows = rows.dropna(subset=[f"`{s.id}`" for s in need]) if need else rows
        indexed = not isinstance(self.model, Function) or any(isinstance(s, Index) for s in domain(self.model))
        return rows if indexed else rows.drop(ORD)


@dataclass(frozen=True)
class ColumnarAdapter(TextAdapter):
    """Chosen columns for each variable, several joined by blanks; empty texts do not count as columns."""

    columns: str = ""
    delimiter: str = r"\s+"

    def fields(self, line: Column) -> Column:
        tokens = F.filter(F.split(F.trim(line), self.delimiter, -1), lambda x: x != "")
        made = []
        for v in self.columns.split(";"):
            parts = [F.get(tokens, F.lit(int(i))) for i in v.split(",")]
            made.append(F.when(F.size(tokens) > max(map(int, v.split(","))), F.concat_ws(" ", *parts)))
        return F.filter(F.array(*made), lambda x: x.isNotNull())


@dataclass(frozen=True)
class RegexAdapter(TextAdapter):
    """The groups of the first match of a pattern, all or chosen ones."""

    pattern: str = ""
    columns: str | None = None

    def fields(self, line: Column) -> Column:
        n = re.compile(self.pattern).groups
        groups = [F.regexp_extract(line, self.pattern, i + 1) for i in range(n)]
        if self.columns:
            groups = [F.concat_ws(" ", *[groups[int(i)] for i in v.split(",")]) for v in self.columns.split(";")]
        return F.when(line.rlike(self.pattern), F.array(*groups))


@dataclass(frozen=True)
class FormattedAdapter(TextAdapter):
    """A FORTRAN-like format: ``nIw`` whole numbers, ``nFw.d`` reals, ``nAw`` texts, ``/`` a new line; blanks are zeros."""

    format: str = ""

    def widths(self) -> list[int]:
        out: list[int] = []
        flat = self.format.replace("/", ",")
        flat = re.sub(r"[()]", ",", flat)
        for item in filter(None, (x.strip() for x in flat.split(","))):
            m = re.match(r"(\d*)([IFA])(\d*)(?:\.\d+)?\Z", item, re.I)
            if not m:
                raise ModelError(f"Unsupported format: {item}")
            out += [int(m[3] or 1)] * int(m[1] or 1)
        return out

    def _joint(self) -> str:
        return ""  # places count on over the lines of a record

    def fields(self, line: Column) -> Column:
        made, at = [], 1
        for w in self.widths():
            made.append(F.translate(F.substring(line, at, w), " ", "0"))
            at += w
        return F.when(F.length(line) >= at - 1, F.array(*made))


@dataclass(frozen=True)
class SubstringAdapter(TextAdapter):
    """Fields by half-open ranges of characters; a field beyond the line's end drops the record."""

    substring: str = ""

    def fields(self, line: Column) -> Column:
        made = []
        for a, b in (map(int, p.split(",")) for p in self.substring.split(";")):
            made.append(F.when(F.length(line) >= b, F.trim(F.substring(line, a + 1, b - a))))
        return F.filter(F.array(*made), lambda x: x.isNotNull())


@dataclass(frozen=True)
class MatrixAdapter(TextAdapter):
    """A matrix of numbers as (row, column) -> value; a bad one has the fill value or is dropped."""

    def samples(self, lines: DataFrame) -> DataFrame:
        d, v = domain(self.model), elements(self.model.range)[0]
        rows = with_ordinal(lines, [F.col(ORD)], "__row").select("__row", F.posexplode(F.split(F.trim("value"), self.delimiter, -1)).alias("__col", "__v"))
        out = rows.select(F.col("__row").cast(d[0].spark).alias(d[0].id), F.col("__col").cast(d[1].spark).alias(d[1].id), parsed(F.col("__v"), v).alias(v.id))
        return out.where(col(v.id).isNotNull())
