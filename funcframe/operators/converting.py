"""Times, bytes and file names as scalar operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funcframe.functions import times
from funcframe.model import ORD, Function, Index, ModelError, Scalar, Tuple, Type, change, col, column_id, columns, domain, elements, find, function, group, range_, scalars
from funcframe.operators.base import Operator


def _time_columns(m: Type) -> list[Scalar]:
    own = [e for e in domain(m) + range_(m) if isinstance(e, Scalar) and e.is_time]
    if len(own) != sum(s.is_time for s in scalars(m)):
        raise ModelError("Nested time is not supported")
    return own


class ConvertTime(Operator):
    """Every time as a count on one scale; a sample with a text that is no time is dropped."""

    def __init__(self, units: str) -> None:
        self.scale = times.scale_of(units)

    def apply_model(self, m: Type) -> Type:
        _time_columns(m)
        return change(m, lambda s: replace(s, type="double", meta=s.meta | {"units": str(self.scale)}) if s.is_time else s)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        for s in _time_columns(m):
            was = times.JAVA if times.is_text(s) else times.scale_of(s.units)
            c = times.millis_of(s).cast("double") if times.is_text(s) else col(s.id)
            df = df.withColumn(s.id, times.convert(c, was, self.scale)).where(col(s.id).isNotNull())
        return df


class FormatTime(Operator):
    """Every time as a text; counts are rounded to milliseconds."""

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern.strip('"')

    def apply_model(self, m: Type) -> Type:
        _time_columns(m)
        return change(m, lambda s: replace(s, type="string", meta={k: v for k, v in s.meta.items() if k not in ("precision", "fillValue", "missingValue")} | {"units": self.pattern}) if s.is_time else s)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        for s in _time_columns(m):
            ms = F.round(times.millis_of(s)).cast("long")
            df = df.withColumn(s.id, F.date_format(F.timestamp_millis(ms), times.spark_format(self.pattern))).where(col(s.id).isNotNull())
        return df


class TimeTupleToTime(Operator):
    """A tuple of date parts as one text time; values and units are joined by blanks."""

    def __init__(self, id: str = "time") -> None:
        self.id = id

    def _tuple(self, m: Type) -> Tuple:
        def look(t: Type):
            if isinstance(t, Tuple):
                if t.id == self.id:
                    yield t
                for e in t.elements:
                    yield from look(e)
            elif isinstance(t, Function):
                yield from look(t.domain)
                yield from look(t.range)

        found = next(look(m), None)
        if found is None:
            raise ModelError(f"Tuple not found: {self.id}")
        if any(not isinstance(e, Scalar) or not e.units for e in found.elements):
            raise ModelError("Each part of a time needs units")
        return found

    def apply_model(self, m: Type) -> Type:
        old = self._tuple(m)
        new = Scalar(self.id, "string", {"units": " ".join(e.units for e in old.elements)}, True)

        def swap(t: Type) -> Type:
            if t is old:
                return new
            if isinstance(t, Tuple):
                return replace(t, elements=tuple(map(swap, t.elements)))
            return replace(t, domain=swap(t.domain), range=swap(t.range)) if isinstance(t, Function) else t

        return swap(m)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        parts = self._tuple(m).elements
        made = F.concat_ws(" ", *[col(e.id).cast("string") for e in parts]).alias(self.id)
        out = df.select("*", made)
        return out.select(*[col(c) for c in columns(self.apply_model(m))], *([F.col(ORD)] if ORD in df.columns else []))


class ConvertBinary(Operator):
    """Bytes as text to base 2, 16 or 64; null stays null."""

    def __init__(self, id: str, base: int) -> None:
        if base not in (2, 16, 64):
            raise ModelError(f"Unsupported base: {base}")
        self.id, self.base = id, base

    def apply_model(self, m: Type) -> Type:
        if find(m, self.id).kind != "binary":
            raise ModelError(f"Not binary: {self.id}")
        media = lambda s: f"{s.meta['mediaType']};base{self.base}" if "mediaType" in s.meta else None
        return change(m, lambda s: replace(s, type="string").with_meta(mediaType=media(s), size=None) if s.id == self.id else s)

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        c = col(self.id)
        if self.base == 2:
            digits = F.split(F.hex(c), "")
            made = F.when(c.isNotNull(), F.array_join(F.transform(F.filter(digits, lambda x: x != ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), ""))
        else:
            made = F.lower(F.hex(c)) if self.base == 16 else F.base64(c)
        return df.withColumn(self.id, made)


class FileListToZipList(Operator):
    """A list of file names as ``entryName -> bytes``: the last part of each path; a repeated one is numbered _001, _002, ..."""

    def __init__(self, uri: str = "uri") -> None:
        self.uri = uri

    def apply_model(self, m: Type) -> Type:
        find(m, self.uri)
        return Function(Scalar("entryName", "string"), Scalar("bytes", "binary"))

    def apply(self, df: DataFrame, m: Type) -> DataFrame:
        base = str(find(m, self.uri).meta.get("baseUri", ""))
        uri = F.when(col(self.uri).rlike("^(/|[a-z][a-z0-9+.-]*:)"), col(self.uri)).otherwise(F.concat(F.lit(base.rstrip("/") + "/" if base else ""), col(self.uri)))
        name = F.regexp_extract(col(self.uri), r"([^/]*)/*$", 1)
        stem, ext = F.regexp_extract(name, r"^(.*?)((?:\.tar)?\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)((?:\.tar)?\.[^.]*)?$", 2)
        k = F.row_number().over(Window.partitionBy("__name").orderBy("__uri")) - 1
        listed = df.select(uri.alias("__uri"), name.alias("__name"), stem.alias("__stem"), ext.alias("__ext"))
        entry = F.when(k == 0, F.col("__name")).otherwise(F.concat("__stem", F.lit("_"), F.lpad(k.cast("string"), 3, "0"), "__ext"))
        return listed.select(entry.alias("entryName"), "__uri").mapInPandas(_read_files, "entryName string, bytes binary")


def _read_files(batches):
    import urllib.request
    from pathlib import Path

    for pdf in batches:
        def read(uri: str) -> bytes:
            if uri.startswith(("http:", "https:", "ftp:", "file:")):
                with urllib.request.urlopen(uri) as got:  # noqa: S310
                    return got.read()
            return Path(uri).read_bytes()

        yield pdf.assign(bytes=[read(u) for u in pdf["__uri"]])[["entryName", "bytes"]]


__all__ = ["ConvertBinary", "ConvertTime", "FileListToZipList", "FormatTime", "Index", "TimeTupleToTime", "column_id", "elements", "function", "group"]
