"""Language identification in two steps: the family by one linear machine, then pairs of related languages by others.

Defined cases. A very long text is counted in windows, with the same result. A null text, and one without a letter, is ``und`` with score 0; so is every text when nothing can be
learned. Repeated rows get equal results, an empty table an empty one. Votes and margins that tie go to the language
that sorts first. Only the id and text columns are read for a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.llm.bytesof import STEP
from funcframe.llm.common import adam, map_texts, share_below, sigmoid, table

#: About this many documents of each language are used to fit, and of all languages at most about so many (160 MB).
PER_LANGUAGE, FIT_ROWS = 900, 20_000
N_GRAMS = 2048
#: Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = np.zeros(256, dtype=np.uint8)  # other bytes are blanks
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(raw: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte pairs and triples of every text, lower-cased and with one kind of blank, and each text's number of them."""
    texts = [t or b"" for t in raw]
    data = _LETTER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)].astype(np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    a, b = data, np.append(data[1:], 0).astype(np.uint32)
    b[np.cumsum(lengths) - 1] = 0  # the blank behind a text is followed by no other text
    before = np.append(np.uint32(0), data[:-1]).astype(np.uint32)
    three = ((before << 16 | a << 8 | b) * np.uint32(2654435761)) >> np.uint32(21)
    two = ((a << 8 | b) * np.uint32(2246822519)) >> np.uint32(21)
    return np.stack([three, two], 1).astype(np.int32), lengths


def histogram(raw: list[bytes | None]) -> np.ndarray:
    """Shares of each text's pairs and triples; a long text is counted window by window."""
    out = np.zeros((len(raw), N_GRAMS))
    short = [i for i, t in enumerate(raw) if len(t or b"") <= STEP]
    if short:
        ids, lengths = grams([raw[i] for i in short])
        flat = (np.repeat(np.arange(len(short)), lengths)[:, None] * N_GRAMS + ids).ravel()
        out[short] = np.bincount(flat, minlength=len(short) * N_GRAMS).reshape(len(short), N_GRAMS) / lengths[:, None]
    for i, t in enumerate(raw):
        if len(t or b"") > STEP:
            total = np.zeros(N_GRAMS, dtype=np.int64)
            for at in range(0, len(t), STEP):
                # a window with its neighbours, of which only their bytes are needed
                ids, _ = grams([t[max(0, at - 1) : at + STEP + 1]])
                own = ids[1 if at else 0 :]
                total += np.bincount((own[:STEP] if at + STEP < len(t) else own).ravel(), minlength=N_GRAMS)
            out[i] = total / (len(t) + 1)
    return out


@dataclass
class Machines:
    """Columns of ``weights``: one machine for each family, then one for each pair of languages within a family."""

    families: list[str]
    languages: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, n_fam = len(margins), len(self.families)
        fam = margins[:, :n_fam].argmax(1) if n_fam else np.zeros(n, dtype=int)
        rest = np.where(np.arange(n_fam) == fam[:, None], -np.inf, margins[:, :n_fam]).max(1) if n_fam > 1 else np.full(n, -np.inf)
        sure = sigmoid(2 * np.minimum(margins[np.arange(n), fam] - rest, 20)) if n_fam > 1 else np.ones(n)
        names = np.empty(n, dtype=object)
        score = np.zeros(n)
        for f, codes in enumerate(self.languages):
            rows = np.flatnonzero(fam == f)
            votes, backing = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for k, (g, i, j) in enumerate(self.pairs):
                if g == f:
                    m = margins[rows, n_fam + k]
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    p = sigmoid(2 * m)
                    backing[:, i] += p
                    backing[:, j] += 1 - p
            best = (votes + backing / max(len(codes), 1) / 2).argmax(1)
            names[rows] = np.array(codes, dtype=object)[best]
            score[rows] = sure[rows] * (backing[np.arange(len(rows)), best] / max(len(codes) - 1, 1) if len(codes) > 1 else 1)
        return list(names), np.clip(score, 0, 1)


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150) -> np.ndarray:
    """A linear machine with squared hinge loss; both classes weigh the same. The last weight is the bias."""
    part = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))

    def gradient(w: list[np.ndarray]) -> list[np.ndarray]:
        gap = np.maximum(0, 1 - y * (x @ w[0]))
        return [-2 * x.T @ (part * y * gap) + 1e-4 * w[0]]

    return adam(gradient, [np.zeros(x.shape[1])], steps, 0.05)[0]


def fit_machines(x: np.ndarray, langs: list[str]) -> Machines:
    """``x``: histograms. Family first, then one machine for each pair of a family's languages."""
    codes = sorted(set(langs))
    lang = np.array(langs, dtype=object)
    families = sorted({_OF.get(c, f"only {c}") for c in codes})
    languages = [[c for c in codes if _OF.get(c, f"only {c}") == f] for f in families]
    scale = 30.0
    full = np.concatenate([np.sqrt(x) * scale / 10, np.ones((len(x), 1))], 1)
    columns, pairs = [], []
    for own in languages:
        columns.append(_svm(full, np.where(np.isin(lang, own), 1.0, -1.0)) if len(families) > 1 else np.zeros(full.shape[1]))
    for f, own in enumerate(languages):
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                rows = (lang == own[i]) | (lang == own[j])
                columns.append(_svm(full[rows], np.where(lang[rows] == own[i], 1.0, -1.0)))
                pairs.append((f, i, j))
    w = np.stack(columns, 1) if columns else np.zeros((N_GRAMS + 1, 0))
    return Machines(families, languages, pairs, w[:-1] * scale / 10, w[-1])


def learnable() -> F.Column:
    """Rows to learn from: a language, and an id whose crc32 as text is not 1 modulo 3 (a null id counts as empty)."""
    return F.col("lang").isNotNull() & ~held_out()


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(documents: DataFrame) -> Machines:
    rows = documents.where(learnable() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    each = min(PER_LANGUAGE, FIT_ROWS / max(len(sizes), 1))
    share = F.coalesce(*[F.when((F.col("lang") == c) & share_below(each / n, F.col("doc_id"), F.lit("language")), True) for c, n in sizes.items()], F.lit(False)) if sizes else F.lit(False)

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        return {"x": [h.astype(np.float32).tobytes() for h in histogram(raw)]}

    got = map_texts(rows.where(share), "text", ["doc_id", "lang"], work, "x binary").orderBy("doc_id", "lang", "x").collect()
    x = np.array([np.frombuffer(r.x, dtype=np.float32) for r in got], dtype=np.float32).reshape(len(got), N_GRAMS)
    return fit_machines(x, [r.lang for r in got])


def identify(documents: DataFrame, machines: Machines, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every row."""

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        margins = np.empty((len(raw), machines.weights.shape[1]))
        for a in range(0, len(raw), 256):
            margins[a : a + 256] = np.sqrt(histogram(raw[a : a + 256])) @ machines.weights + machines.bias
        names, score = machines.predict(margins)
        for i, t in enumerate(raw):
            if not machines.families or t is None or not _has_letter(t):
                names[i], score[i] = "und", 0.0
        return {"lang_pred": names, "score": score}

    return map_texts(documents, text, keep, work, "lang_pred string, score double")


def _has_letter(text: bytes) -> bool:
    head = text[:256]
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in head) or any(c.isalpha() for c in text.decode())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents.withColumn("held_out", held_out()), fit(documents), ["doc_id", "held_out"])
