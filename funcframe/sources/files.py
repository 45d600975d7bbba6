"""Lists of files, generated granule lists, fixed-width binary records, databases, and bytes by URI."""

from __future__ import annotations

import os
import re
import urllib.request
from datetime import UTC, datetime
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.functions.times import iso_millis, iso_text
from funcframe.model import ORD, Function, Index, ModelError, Scalar, Type, col, columns, domain, elements, range_, scalars

#: Big-endian codes of fixed-width types.
CODES = {"boolean": "?", "byte": "b", "short": "h", "int": "i", "long": "q", "float": "f", "double": "d"}


def fetch(uri: str) -> bytes:
    """Bytes of a local path or of a file, http(s) or ftp(s) URI (anonymous; at most three redirects)."""
    scheme = urlparse(uri).scheme
    if scheme in ("http", "https", "ftp"):
        class Few(urllib.request.HTTPRedirectHandler):
            max_redirections = 3

        with urllib.request.build_opener(Few).open(uri) as got:
            return got.read()
    if scheme == "ftps":
        from ftplib import FTP_TLS

        u, out = urlparse(uri), []
        with FTP_TLS(u.hostname) as ftp:
            ftp.login(u.username or "anonymous", u.password or "")
            ftp.prot_p()
            ftp.retrbinary(f"RETR {u.path}", out.append)
        return b"".join(out)
    with open(urlparse(uri).path if scheme == "file" else uri, "rb") as f:
        return f.read()


def lines_of(spark: SparkSession, uri: str) -> DataFrame:
    """(value, ORD) of a text resource; local and Hadoop paths are read in parallel, others by one fetch."""
    if urlparse(uri).scheme in ("http", "https", "ftp", "ftps"):
        text = fetch(uri).decode().splitlines()
        return spark.createDataFrame([(t, i) for i, t in enumerate(text)], f"value string, {ORD} long")
    return spark.read.text(uri).select("value", F.monotonically_increasing_id().alias(ORD))


def file_list(spark: SparkSession, model: Type, root: str, pattern: str, columns_: str | None = None, base_dir: str | None = None) -> DataFrame:
    """Files under a folder, by a pattern for each level of the path; groups become domain values, then uri and size."""
    levels = [re.compile(p) for p in pattern.split("/")]
    rows: list[tuple] = []

    def walk(folder: str, depth: int, found: tuple[str, ...]) -> None:
        for name in sorted(os.listdir(folder)):
            m = levels[depth].fullmatch(name)
            path = os.path.join(folder, name)
            if not m:
                continue
            got = found + m.groups()
            if depth + 1 < len(levels):
                if os.path.isdir(path):
                    walk(path, depth + 1, got)
            elif os.path.isfile(path):
                rows.append((got, os.path.relpath(path, base_dir) if base_dir else path, os.path.getsize(path)))

    walk(root, 0, ())
    d, r = domain(model), range_(model)
    out = []
    for groups, uri, size in rows:
        keys = [" ".join(groups[int(i)] for i in v.split(",")) for v in columns_.split(";")] if columns_ else list(groups)
        if len(keys) == len(d):
            out.append((*keys, uri, *([str(size)] if len(r) > 1 else [])))
    names = columns(model)
    df = spark.createDataFrame(out, ", ".join(f"`{n}` string" for n in names))
    from funcframe.sources.text import parsed

    return df.select(*[parsed(col(s.id), s).alias(s.id) for s in [*d, *r]])


def granule_list(spark: SparkSession, model: Type, start: str, step: str, pattern: str, end: str | None = None) -> DataFrame:
    """time -> uri for each step from start to end (inclusive; now if not given). ``pattern`` takes date codes as ``%1$tY``."""
    m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", step)
    if not m or not any(m.groups()):
        raise ModelError(f"Invalid duration: {step}")
    first = iso_millis(start)
    last = iso_millis(end) if end else int(datetime.now(UTC).timestamp() * 1000)
    if first is None or last is None:
        raise ModelError("Invalid time")
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups())
    interval = f"make_interval({y}, {mo}, 0, {d}, {h}, {mi}, {s})"
    t, uri = domain(model)[0], range_(model)[0]
    codes = {"Y": "yyyy", "m": "MM", "d": "dd", "j": "DDD", "H": "HH", "M": "mm", "S": "ss", "y": "yy"}
    parts = [F.date_format("t", codes[p[-1]]) if p.startswith("%") else F.lit(p) for p in re.findall(r"%(?:\d+\$)?t[YmdjHMSy]|[^%]+", pattern)]
    times = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_millis({first}L), timestamp_millis({last}L), {interval})")).alias("t"))
    return times.select(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(t.id), F.concat(*parts).alias(uri.id))


def record_layout(model: Type) -> list[tuple[Scalar, str]]:
    """Struct codes of the scalars that are stored; texts need a size."""
    out = []
    for s in scalars(model):
        if isinstance(s, Index):
            continue
        if s.kind == "string":
            if "size" not in s.meta:
                raise ModelError(f"A text of fixed width needs a size: {s.id}")
            out.append((s, f"{int(s.meta['size'])}s"))
        elif s.kind in CODES:
            out.append((s, CODES[s.kind]))
        else:
            raise ModelError(f"No binary form: {s.type}")
    return out


def binary_records(spark: SparkSession, model: Type, path: str) -> DataFrame:
    """Big-endian records of fixed width; an incomplete last record is dropped."""
    from funcframe.encoders.parallel import records_of

    return records_of(spark.read.format("binaryFile").load(path).select("content"), model)


def jdbc(spark: SparkSession, model: Type, url: str, table: str, predicate: str | None = None, fetch_size: int = 8192, **options: str) -> DataFrame:
    """A table or view. Filters, columns and limits of later operators are pushed down by Spark. Nulls take the fill value,
    stay where the missing value is null, and are errors otherwise."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **options).load()
    if predicate:
        df = df.where(predicate)
    made = []
    for s in elements(model.domain) + elements(model.range) if isinstance(model, Function) else elements(model):
        c = col(s.meta.get("sourceId", s.id)).cast(s.spark)
        if "fillValue" in s.meta:
            c = F.coalesce(c, F.lit(str(s.meta["fillValue"])).cast(s.spark))
        elif s.meta.get("missingValue") != "null":
            c = F.coalesce(c, F.raise_error(F.lit(f"Null in {s.id}")))
        made.append(c.alias(s.id))
    return df.select(*made)


def select_statement(model: Type, table: str, operations: list) -> str:
    """The SQL that a request stands for: columns with new names, conditions, order by the domain, a limit."""
    from funcframe import operators as ops

    names = {s.id: s.id for s in scalars(model)}
    where, limit, m = [], None, model
    for op in operations:
        if isinstance(op, ops.Selection):
            s = next(x for x in scalars(m) if x.id == op.id)
            value = op.value if s.kind != "string" or op.value.startswith("'") else "'" + op.value.strip('"') + "'"
            where.append(f"{names[op.id]} {'=' if op.op == '==' else '<>' if op.op == '!=' else op.op} {value}")
        elif isinstance(op, ops.Rename):
            names[op.new] = names.pop(op.old)
        elif isinstance(op, (ops.Take, ops.Head)):
            limit = op.n if limit is None else min(limit, op.n)
        elif not isinstance(op, ops.Projection):
            raise ModelError(f"No SQL for {op}")
        m = op.apply_model(m)
    shown = [names[c] + (f" AS {c}" if names[c] != c else "") for c in columns(m)]
    keys = [names[s.id] for s in domain(m) if not isinstance(s, Index)]
    out = f"SELECT {', '.join(shown)} FROM {table}"
    out += f" WHERE {' AND '.join(where)}" if where else ""
    out += f" ORDER BY {' ASC, '.join(keys)} ASC" if keys else ""
    return out + (f" FETCH FIRST {limit} ROWS ONLY" if limit is not None else "")


__all__ = ["binary_records", "fetch", "file_list", "granule_list", "iso_text", "jdbc", "lines_of", "record_layout", "select_statement"]
