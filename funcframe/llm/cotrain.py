"""Quality classifier by co-training: a view of the text and one of the metadata teach each other, then score together.

Defined cases. A null or empty text has a text view of zeros; null metadata have a value of their own. Repeated rows get
equal scores; an empty table gives an empty result. Without labels of both kinds, every score is the share of good labels
(one half without any). Every document whose id has no label can be exchanged, those without an id too; documents that are
equal in both views are exchanged once. A document is kept at a score of ``THRESHOLD`` or more, ties included. Only the named columns are
read; other columns pass through :func:`keep_good` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.llm.bytesof import STEP, member, mix64, words_of
from funcframe.llm.common import adam, map_texts, materialise, run_sums, share_below, sigmoid, table

#: About this many labelled documents are used to fit; all documents without a label are searched for sure ones in each round.
LABELLED = 3000
ROUNDS, PER_ROUND, SURE = 4, 200, 0.95
THRESHOLD = 0.5
N_STATS, N_HASH = 14, 128
N_TEXT, N_META = N_STATS + N_HASH, 48
META = ["source", "lang", "n_chars"]

_SYMBOL, _UPPER, _DIGIT, _STOP, _PIPE = member(b"#*$%&|<>"), member(bytes(range(65, 91))), member(bytes(range(48, 58))), member(b".,;"), member(b"|")
_MARK = member(b"!?")


def text_view(raw: list[bytes | None]) -> np.ndarray:
    """Shares of signs, repetition of words and pairs of words, and a hashed histogram of byte pairs."""
    w = words_of(raw)
    size = np.diff(w.ends, prepend=0)
    n, chars = np.maximum(w.counts, 1), np.maximum(size, 1)
    x = np.zeros((len(raw), N_TEXT))
    x[:, 0] = 1
    for i, signs in enumerate((_SYMBOL, _UPPER, _DIGIT, _STOP, _PIPE, _MARK)):
        x[:, 1 + i] = np.minimum(run_sums(signs[w.data], size) / n, 3)
    x[:, 7] = run_sums(_UPPER[w.data], size) / chars
    codes, doc = w.hashes(), w.doc.astype(np.uint64)
    own = codes ^ mix64(doc + np.uint64(1))
    x[:, 8] = _repeats(own, w.counts, n)
    if len(own) > 1:
        after = np.concatenate([own[1:] == own[:-1], [False]])  # equal hashes include the text
        x[:, 9] = run_sums(after.astype(np.int64), w.counts) / n
        two = np.append(mix64(own[1:]) ^ own[:-1], own[-1:])
        last = np.cumsum(w.counts)[w.counts > 0] - 1  # a text's last word begins no pair
        two[last] = mix64(own[last])
        x[:, 10] = _repeats(two, w.counts, n)
    x[:, 11] = np.log1p(w.counts) / 8
    x[:, 12] = np.minimum(run_sums(w.data == 10, size) / n, 1)
    x[:, 13] = np.minimum(size / n, 30) / 10
    hist = np.zeros(len(raw) * N_HASH, dtype=np.int64)
    for at in range(0, len(w.data), STEP):
        d = w.data[at : at + STEP + 1].astype(np.uint32)
        pair = (((d[:-1] * 31 + d[1:]) * np.uint32(2654435761)) >> np.uint32(25)).astype(np.int64)
        pair = np.append(pair, 0) if len(d) <= STEP else pair
        of = np.searchsorted(w.ends, np.arange(at, at + len(pair)), side="right")
        last = w.ends - 1 - at
        pair[last[(last >= 0) & (last < len(pair))]] = 0  # the line feed behind a text
        hist += np.bincount(of * N_HASH + pair, minlength=len(hist))
    x[:, N_STATS:] = hist.reshape(len(raw), N_HASH) / chars[:, None] * 10
    x[w.counts == 0, 1:] = 0
    return x


def _repeats(keys: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The share of a text's keys that it has had before."""
    order = np.argsort(keys)
    s = keys[order]
    old = np.zeros(len(keys), dtype=np.int64)
    old[order[1:][s[1:] == s[:-1]]] = 1
    return run_sums(old, counts) / n


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed source and language, and the length that the metadata state."""
    import xxhash

    x = np.zeros((batch.num_rows, N_META))
    x[:, 0] = 1
    for at, width, name in ((1, 30, "source"), (31, 12, "lang")):
        for i, v in enumerate(batch.column(name).to_pylist()):
            x[i, at if v is None else at + 1 + xxhash.xxh32_intdigest(str(v)) % (width - 1)] = 1
    chars = batch.column("n_chars").to_pylist()
    size = np.log1p([max(c or 0, 0) for c in chars])
    x[:, 43], x[:, 44], x[:, 45] = size / 10, (size / 10) ** 2, [c is None for c in chars]
    x[:, 46], x[:, 47] = size < 4, size > 9
    return x


@dataclass
class View:
    """A logistic regression and the line that calibrates its margin."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights) + self.shift


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 250) -> np.ndarray:
    def gradient(w: list[np.ndarray]) -> list[np.ndarray]:
        return [x.T @ (sigmoid(x @ w[0]) - y) / len(y) + ridge * w[0]]

    return adam(gradient, [np.zeros(x.shape[1])], steps, 0.2)[0]


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's line on rows that the classifier was not fitted on, with his smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def gradient(w: list[np.ndarray]) -> list[np.ndarray]:
        d = sigmoid(w[0][0] * margin + w[0][1]) - t
        return [np.array([(d * margin).mean(), d.mean()])]

    slope, shift = adam(gradient, [np.array([1.0, 0.0])], 300, 0.1)[0]
    return max(slope, 0.0), shift


@dataclass
class Model:
    """Both views and the log odds of a good label, which both contain and which count once."""

    text: View
    meta: View
    prior: float
    exchanged: tuple[int, int] = (0, 0)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.margin(text), self.meta.margin(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


#: For each view, what it is sure of: keys and both views' features of good documents, then of bad ones.
Sure = list[list[tuple[list[int], np.ndarray, np.ndarray]]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Callable[[list[View], list[set[int]]], Sure]) -> Model:
    """``y``: 1 good, 0 bad. In each round each view labels what it is sure of in the pool, for the other view.

    ``surest`` gets both views and the keys that each has been given, and finds up to ``PER_ROUND`` new ones of a kind."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Model(View(np.zeros(N_TEXT), 1, prior), View(np.zeros(N_META), 1, prior), prior)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    check = held if held.any() else ~held
    views = [[x[~held], y[~held].astype(float), x[check]] for x in (text, meta)]
    has: list[set[int]] = [set(), set()]
    fitted: list[View] = []
    given = [0, 0]
    for turn in range(ROUNDS + 1):
        fitted = []
        for x, target, x_check in views:
            w = _fit(x, target)
            fitted.append(View(w, *_calibrate(x_check @ w, y[check])))
        if turn == ROUNDS:
            break
        found = surest(fitted, has)
        for i, kinds in enumerate(found):
            other = 1 - i
            for good, (keys, *both) in zip((1, 0), kinds, strict=True):
                views[other][0] = np.concatenate([views[other][0], both[other]])
                views[other][1] = np.concatenate([views[other][1], np.full(len(keys), float(good))])
                has[other].update(keys)
                given[i] += len(keys)
        if not any(keys for kinds in found for keys, *_ in kinds):
            break
    return Model(*fitted, prior, tuple(given))


def _features(raw: list[bytes | None], kept: pa.RecordBatch) -> dict:
    return {"t": list(map(_packed, text_view(raw))), "m": list(map(_packed, meta_view(kept)))}


def _unpacked(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), width).astype(float)


def unlabelled(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Both views of every document whose id is not among the known ones, and a key of the two, kept on disk."""
    got = map_texts(documents.select("doc_id", "text", *META), "text", ["doc_id", *META], _features, "t binary, m binary").select("doc_id", "t", "m", F.xxhash64("t", "m").alias("key"))
    got = got.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("key")).otherwise(F.lit(0)))  # null ids are many tasks' work
    ids = known.select("doc_id", F.lit(0).cast("long").alias("spread"))
    return materialise(got.join(ids, ["doc_id", "spread"], "left_anti").select("key", "t", "m"), "unlabelled")


_BEST = "kind int, margin double, key long, t binary, m binary"


def _best_of(rows: Iterator[tuple]) -> list[tuple]:
    """The first ``PER_ROUND`` rows of each kind by margin and then key, each key once."""
    out: dict[int, dict[int, tuple]] = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        mine = out.setdefault(r[0], {})
        if len(mine) < PER_ROUND:
            mine.setdefault(r[2], r)
    return [r for mine in out.values() for r in mine.values()]


def find_surest(pool: DataFrame, views: list[View], has: list[set[int]]) -> Sure:
    """One pass over the pool: each task, then each of a few, hands on its best rows, and the driver merges theirs."""
    edge = float(np.log(SURE / (1 - SURE)))
    taken = [np.fromiter(h, dtype=np.int64, count=len(h)) for h in has]

    def rows_of(best: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in best], type=k) for i, k in enumerate(kinds)], names=["kind", "margin", "key", "t", "m"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            t, m = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (view, x) in enumerate(zip(views, (_unpacked(t, N_TEXT), _unpacked(m, N_META)), strict=True)):
                margin = np.round(view.margin(x), 9)
                free = ~np.isin(keys, taken[1 - i])
                for good in (1, 0):
                    own = margin if good else -margin
                    able = np.flatnonzero(free & (own >= edge))
                    able = able[np.unique(keys[able], return_index=True)[1]]
                    able = able[np.lexsort((keys[able], -own[able]))[:PER_ROUND]]
                    best += [(2 * i + 1 - good, float(own[j]), int(keys[j]), t[j], m[j]) for j in able]
            best = _best_of(best)
        yield rows_of(best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            best = _best_of([*best, *zip(*(c.to_pylist() for c in batch.columns), strict=True)])
        yield rows_of(best)

    first = pool.mapInArrow(search, _BEST)
    few = int(np.ceil(np.sqrt(pool.rdd.getNumPartitions())))
    got = _best_of([tuple(r) for r in first.repartition(max(few, 1)).mapInArrow(merge, _BEST).collect()])
    out: Sure = [[], []]
    for kind in range(4):
        mine = [r for r in got if r[0] == kind]
        out[kind // 2].append(([r[2] for r in mine], _unpacked([r[3] for r in mine], N_TEXT), _unpacked([r[4] for r in mine], N_META)))
    return out


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Fits on a hashed share of the labelled documents, about ``LABELLED``, and on what the views are sure of among all others."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.where(share_below(LABELLED / max(known.count(), 1), F.col("doc_id"), F.lit("labelled")))
    columns = ["doc_id", "text", *META]
    rows = documents.select(*columns).join(F.broadcast(picked), "doc_id")  # about LABELLED ids
    got = map_texts(rows.select(*columns, "quality"), "text", ["doc_id", *META, "quality"], _features, "t binary, m binary").select("doc_id", "quality", "t", "m").orderBy("doc_id", "quality", "t").collect()
    quality = np.array([int(r.quality != 0) for r in got], dtype=int)
    pool: list[DataFrame] = []

    def surest(views: list[View], has: list[set[int]]) -> Sure:
        if not pool:
            pool.append(unlabelled(documents, known))
        return find_surest(pool[0], views, has)

    return co_train(_unpacked([r.t for r in got], N_TEXT), _unpacked([r.m for r in got], N_META), quality, surest)


def _packed(row: np.ndarray) -> bytes:
    return row.astype(np.float32).tobytes()


def score(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, both views' calibrated probabilities, the combined ``score`` and ``kept`` for every row."""

    def work(raw: list[bytes | None], kept: pa.RecordBatch) -> dict:
        a, b, both = model.scores(text_view(raw), meta_view(kept))
        return {"text_score": a, "meta_score": b, "score": both, "kept": both >= THRESHOLD}

    need = [*keep, *(c for c in META if c not in keep)]
    got = map_texts(documents, text, need, work, "text_score double, meta_score double, score double, kept boolean")
    return got.select(*[f"`{c}`" for c in (*keep, "text_score", "meta_score", "score", "kept")])


def keep_good(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the classifier keeps, with their columns as they are."""

    def work(raw: list[bytes | None], kept: pa.RecordBatch) -> dict:
        both = model.scores(text_view(raw), meta_view(kept))[2]
        return {"copy_in_work": pa.array(raw, type=pa.binary()).cast(pa.string()), "where": both >= THRESHOLD}

    keep = [c for c in documents.columns if c != text]
    got = map_texts(documents, text, keep, work, "copy_in_work string")
    return got.toDF(*keep, text).select(*[f"`{c}`" for c in documents.columns])


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")), ["doc_id"])
