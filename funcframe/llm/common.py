"""Shared pieces of the training-data operators: scratch tables, text batches and exact prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.scratch import materialise, scratch_dir  # noqa: F401

#: A word: a run of anything but ASCII white space (``bytes.split()`` cuts at exactly these bytes).
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about this many UTF-8 bytes, which bounds a Python worker's memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def slices(raw: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; one longer text makes a range of its own."""
    start = held = 0
    for i, text in enumerate(raw):
        size = len(text) if text else 0
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(raw):
        yield start, len(raw)


def map_texts(
    df: DataFrame,
    text: str | Column,
    keep: list[str],
    work: Callable[[list[bytes | None], pa.RecordBatch], dict[str, object]],
    out: str,
) -> DataFrame:
    """Columns ``keep`` of every row, and those of the DDL ``out`` that ``work`` makes of a list of UTF-8 texts.

    ``work`` gets the texts of a slice and the slice's kept columns, and returns a list, numpy or Arrow array for each
    column of ``out``; a value under the key ``"where"`` (a boolean mask) leaves rows out.
    """
    spark = df.sparkSession
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    held = fresh(df, "text_in_work")
    source = df.select(*[F.col(f"`{c}`") for c in keep], column.cast("string").alias(held))
    made = spark.createDataFrame([], out).schema
    schema = type(made)([*source.schema.fields[:-1], *made.fields])
    names = [f.name for f in made.fields]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(made)
        for batch in batches:
            raw = batch.column(n_keep).cast(pa.binary()).to_pylist()
            for a, b in slices(raw):
                part = batch.slice(a, b - a)
                kept = pa.RecordBatch.from_arrays(part.columns[:n_keep], schema=pa.schema([batch.schema.field(i) for i in range(n_keep)]))
                got = work(raw[a:b], kept)
                columns = []
                for name, kind in zip(names, kinds, strict=True):
                    v = got[name]
                    v = v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=kind.type, from_pandas=False)
                    columns.append(v if v.type == kind.type else v.cast(kind.type))
                done = pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *names])
                where = got.get("where")
                yield done if where is None else done.filter(pa.array(where))

    return source.mapInArrow(run, schema)


def lengths_to_ids(lengths: np.ndarray) -> np.ndarray:
    """[2, 0, 1] gives [0, 0, 2]: for each element, the number of its run."""
    return np.repeat(np.arange(len(lengths)), lengths)


def run_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; 0 for an empty run."""
    ends = np.cumsum(lengths)
    small = values.dtype == bool and len(values) < 1 << 31
    total = np.zeros(len(values) + 1, dtype=np.int32 if small else np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:], dtype=total.dtype)
    got = total[ends] - total[ends - lengths]
    return got.astype(np.int64) if small else got


def share_below(share: float, *by: Column) -> Column:
    """Keeps about ``share`` of the rows, the same at every run, by a hash of ``by``."""
    edge = int(min(1.0, share) * (1 << 30))
    return F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < F.lit(edge)


def adam(gradient: Callable[[list[np.ndarray]], list[np.ndarray]], start: list[np.ndarray], steps: int, rate: float) -> list[np.ndarray]:
    """Full-batch Adam with a rate that falls to a tenth; the same result at every run."""
    w = [np.array(x, dtype=np.float64) for x in start]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        r = rate * (1 - 0.9 * t / steps)
        for i, g in enumerate(gradient(w)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - r * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))
