"""Packing along a space-filling curve: neighbours on the Hilbert curve of hashed, projected documents share sequences.

Documents are sorted by the Hilbert key of their vector and laid one behind the other; the line of ids is cut every
``LENGTH`` ids. So every sequence but the last is full, and a document is cut only where a sequence ends.

Defined cases. A null or empty text is the end id alone. Repeated rows are packed one by one. Equal keys go by the row's
place in the written table. An empty table gives an empty result. The kept columns travel in one struct, so names cannot
clash. A very long text spans as many sequences as it needs.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funcframe.llm.bytesof import mix64
from funcframe.llm.common import map_texts, materialise, table
from funcframe.llm.tokens import tokenizer

LENGTH, END_ID = 4096, 2
#: Buckets of the hashed vector, dimensions it is projected to, bits of each on the curve.
BUCKETS, DIMS, BITS = 64, 4, 8
#: Hashes of this many ids are tabulated; larger ids share them.
TABLE = 1 << 16


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each integer point (rows, 0 <= x < 2**bits) on the Hilbert curve, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMS))


@functools.cache
def _signed_buckets() -> np.ndarray:
    """The hashed bucket of each id, those of negative sign in the second half."""
    h = mix64(np.arange(1, TABLE + 1, dtype=np.uint64))
    return ((h % np.uint64(BUCKETS)) + (h >> np.uint64(63)) * np.uint64(BUCKETS)).astype(np.int64)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents: signed hashed counts of ids, brought to length one, projected, cut into equal cells."""
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *ids])
    at = _signed_buckets()[flat % TABLE]
    at += np.repeat(np.arange(0, 2 * BUCKETS * len(ids), 2 * BUCKETS), sizes)
    v = np.bincount(at, minlength=2 * BUCKETS * len(ids)).reshape(len(ids), 2, BUCKETS)
    v = (v[:, 0] - v[:, 1]).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    cells = np.floor((np.clip(v @ _projection(), -3, 3) + 3) / 6 * (1 << BITS))
    return hilbert(np.minimum(cells, (1 << BITS) - 1))


def tokenised(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``row`` (a struct of ``keep``), ``place`` on the curve, ``n`` ids with the end id, and ``ids`` packed without it."""
    held = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        t = tokenizer(path)
        packed = [t.encode(x or b"") for x in raw]
        ids = [np.frombuffer(p, dtype=t.dtype) for p in packed]
        return {"place": curve_keys(ids), "n": [len(i) + 1 for i in ids], "ids": packed, "width": [t.dtype.itemsize] * len(raw)}

    return map_texts(held, "text", ["row"], work, "place long, n long, ids binary, width int")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows their partition and the ids before them in it."""
    from pyspark import TaskContext

    part, so_far = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        before = so_far + np.cumsum(n) - n
        so_far += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(before), batch.column(1)], names=["rid", "part", "before", "n"])


def starts(rows: DataFrame) -> DataFrame:
    """(rid, at): for rows (rid, place, n) the ids before each in the order of (place, rid), by prefix sums over ranges."""
    ordered = rows.repartitionByRange("place", "rid").sortWithinPartitions("place", "rid").select("rid", "n")
    local = materialise(ordered.mapInArrow(_running, "rid long, part long, before long, n long"), "order")
    parts = local.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition
    lead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(parts.select("part", lead.alias("lead")), "part").select("rid", (F.col("lead") + F.col("before")).alias("at"))


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``keep`` and ``PIECES``, a row for each piece of each document."""
    t = materialise(tokenised(documents, keep, text, path).withColumn("rid", F.monotonically_increasing_id()), "tokens")
    placed = t.select("rid", "row", "ids", "width").join(starts(t.select("rid", "place", "n")).hint("merge"), "rid").select("row", "ids", "width", "at")
    made = "row " + documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")).schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], [[] for _ in range(6)]
            for i, (ids, width, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                full = np.append(np.frombuffer(ids, dtype=f"<u{width}"), END_ID).astype("<u4")
                a = 0
                while a < len(full):
                    sequence, offset = divmod(at + a, length)
                    b = min(len(full), a + length - offset)
                    take.append(i)
                    for o, v in zip(out, (a, b - a, zlib.crc32(full[a:b].tobytes()), len(full), sequence, offset), strict=True):
                        o.append(v)
                    a = b
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, type=pa.int64())), *(pa.array(o, type=pa.int64()) for o in out)], names=["row", *(c.split()[0] for c in PIECES.split(", "))])

    got = placed.mapInArrow(cut, f"{made}, {PIECES}")
    return got.select("row.*", *(c.split()[0] for c in PIECES.split(", ")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"), ["doc_id"])
