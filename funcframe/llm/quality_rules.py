"""Quality rules: a conditional random field labels each line content or boilerplate; the share of content decides.

The field is fitted on labels of lines. Boilerplate are all lines of a document labelled bad; in good ones, short lines that
documents with different longest lines share, menu-like lines, and lines of menus and notices that the fit plants at
random places of copies. All others are content, so sequences change from one label to the other within documents.

Defined cases. A null or empty text has no words: all counts are 0, it fails the base rules and is not kept. Repeated
rows are judged one by one and alike. An empty table gives an empty result. Null ids stay null. Only the id and text
columns are read, so extra columns cannot clash. A very long text is one slice of work; memory grows with the longest
single text, not with the batch (some 28 bytes for each byte of it). Where a label's scores tie, the line is content.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe.llm import crf
from funcframe.llm.bytesof import member, mix64, words_of
from funcframe.llm.common import lengths_to_ids, map_texts, run_sums, share_below, table

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: A text is kept when at least this share of its words lies in lines labelled content.
CONTENT_SHARE = 0.5
#: The field is fitted on about so many labelled documents, on those of at most so many lines; all their lines, in runs.
TRAIN_DOCS, DOC_LINES, RUN_LINES = 600, 5000, 30
#: Lines of at most so many words are boilerplate where sampled documents with so many different longest lines have them.
SHARED_WORDS, SHARED_BY = 25, 3
#: Planted boilerplate: %w stands for a word of the document, %d for a digit.
NOTICES = (
    "Home | About | Contact", "%w | %w | %w | %w | %w", "%w | %w, | %w | %w | %w | %w | %w", "« %w | %w »", "%w > %w > %w", "%w / %w / %w / %w", "Tags: %w, %w, %w", "Share: %w %w %w",
    "Copyright %d%d%d%d %w. All rights reserved.", "© %d%d%d%d %w", "Posted by %w on %d%d/%d%d/%d%d%d%d", "Page %d of %d%d", "%d%d comments", "Read more >>", "Sign in", "Subscribe to our newsletter!",
    "Released under the %w License.", "This work is licensed under the %w License, version %d.", "Terms of Use | Privacy", "Click here to %w", "CLICK HERE!!!", "*** %w ***", "[%w] [%w] [%w]", "#%w #%w #%w",
)

OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"

_SYMBOL, _UPPER, _DIGIT, _STOP = member(b"#*$%&|<>"), member(bytes(range(65, 91))), member(bytes(range(48, 58))), member(b".!?;:")
_END, _BAR = member(b".!?"), member(b"|/>#[")
N_FEATURES = 17
KNOWN = 12


def repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a window of eight words found at two or more of its places.

    ``codes``: a 64-bit hash of each word. Windows are compared by 64-bit hashes of their words and text.
    """
    n = len(codes)
    none = np.zeros(len(counts), dtype=np.int64)
    doc = lengths_to_ids(counts)
    at = np.arange(max(0, n - WINDOW + 1))
    at = at[doc[at] == doc[at + WINDOW - 1]]
    if len(at) < 2:
        return none
    h = mix64(doc[at].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        h = (h ^ codes[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    order = np.argsort(h)
    h = h[order]
    same = np.concatenate([[False], h[1:] == h[:-1], [False]])
    found = at[order[same[1:] | same[:-1]]]
    hit = np.zeros(n + WINDOW + 1, dtype=np.int64)
    hit[found] += 1
    hit[found + WINDOW] -= 1
    return run_sums((np.cumsum(hit)[:n] > 0).astype(np.int64), counts)


@dataclass
class Model:
    """The field, and hashes of the lines that sampled documents share, in order."""

    field: crf.Crf
    shared: np.ndarray

    def emit(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        x[:, KNOWN] = np.isin(lines, self.shared)
        return x @ self.field.weights


def measure(raw: list[bytes | None]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The base counts of each text; the features of each line with a word, each text's number of such lines, the lines'
    words and a hash of these."""
    w = words_of(raw)
    n_docs, data = len(raw), w.data
    ends = np.flatnonzero(data == 10) + 1
    begins = np.concatenate([[0], ends[:-1]])

    def by_line(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(mask, out=total[1:], dtype=np.int32)
        return (total[ends] - total[begins]).astype(np.int64)

    line_doc = np.searchsorted(w.ends, ends, side="left")
    word_line = np.searchsorted(ends, w.begin, side="right")
    n_in_line = np.bincount(word_line, minlength=len(ends))
    glyphs, symbols = by_line(((data & 0xC0) != 0x80) & ~w.space), by_line(_SYMBOL[data])
    per_doc = lambda v: np.bincount(line_doc, weights=v, minlength=n_docs).astype(np.int64)

    codes = w.hashes()
    own = codes ^ mix64(word_line.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own)
    own = own[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
    distinct = np.bincount(word_line[order[new]], minlength=len(ends))

    repeated = np.zeros(len(ends), dtype=bool)
    dup = np.zeros(n_docs, dtype=np.int64)
    row = 0
    for i, text in enumerate(raw):
        lines = (text or b"").split(b"\n")
        if len(lines) > 1:
            seen: set[bytes] = set()
            for k, line in enumerate(lines, row):
                if n_in_line[k]:
                    if line in seen:
                        repeated[k] = True
                        dup[i] += 1
                    else:
                        seen.add(line)
        row += len(lines)
    counts = {"n_words": w.counts, "word_chars": per_doc(glyphs), "n_symbols": per_doc(symbols), "n_dup_lines": dup, "n_repeat_words": repeated_words(codes, w.counts)}

    real = n_in_line > 0
    n = n_in_line[real].astype(float)
    g = np.maximum(glyphs, 1)[real].astype(float)
    upper, same = by_line(_UPPER[data])[real], 1 - distinct[real] / n
    x = np.empty((int(real.sum()), N_FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.log1p(n) / 3
    x[:, 2] = np.minimum(g / n, 20) / 10
    x[:, 3] = np.minimum(symbols[real] / n, 3)
    x[:, 4] = upper / g
    x[:, 5] = by_line(_DIGIT[data])[real] / g
    x[:, 6] = np.minimum(by_line(_STOP[data])[real] / n, 2)
    x[:, 7] = same
    x[:, 8] = repeated[real]
    x[:, 9] = n < 3
    x[:, 10] = upper > 0.5 * g
    x[:, 11] = same * np.log1p(n) / 3
    first = (np.cumsum(n_in_line) - n_in_line)[real]
    if len(first):
        x[:, 13] = np.add.reduceat(_UPPER[w.data[w.begin]].astype(np.int64), first) / n
        x[:, 14] = _END[data[w.end[first + n_in_line[real] - 1] - 1]]
        x[:, 15] = (n < 9) & (x[:, 14] == 0)
        x[:, 16] = np.minimum(by_line(_BAR[data])[real] / n, 1)
    place = np.arange(len(codes)) - np.repeat(first, n_in_line[real])
    lines = np.add.reduceat(mix64(codes ^ mix64(place.astype(np.uint64) + np.uint64(1))), first) if len(first) else codes
    return counts, x, np.bincount(line_doc[real], minlength=n_docs), n_in_line[real], lines


def plant(text: bytes) -> tuple[bytes, list[bool]]:
    """The text with runs of one to four notices at one to three places, the same each time; for each line with a word,
    whether it was planted."""
    rng = np.random.default_rng(zlib.crc32(text))
    words = text.decode().split() or ["x"]
    lines = [(line, False) for line in text.decode().split("\n")]
    for _ in range(rng.integers(1, 4)):
        run = []
        for _ in range(rng.integers(1, 5)):
            line = NOTICES[rng.integers(len(NOTICES))].replace("%d", "7")
            while "%w" in line:
                line = line.replace("%w", words[rng.integers(len(words))].strip(".,|%").capitalize() or "X", 1)
            run.append((line, True))
        at = rng.choice([0, len(lines), rng.integers(len(lines) + 1)])
        lines[at:at] = run
    return "\n".join(line for line, _ in lines).encode(), [bad for line, bad in lines if line.encode().split()]


def _menu(x: np.ndarray) -> np.ndarray:
    """Lines of short items with a bar for each two words at least."""
    return (x[:, 16] >= 0.5) & (x[:, 14] == 0)


def fit_lines(documents: DataFrame, labels: DataFrame) -> Model:
    """A field fitted on the lines of about ``TRAIN_DOCS`` labelled documents of at most ``DOC_LINES`` lines.

    Without labelled documents all lines tie, that is, they are content.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    picked = known.where(share_below(TRAIN_DOCS / max(n, 1), F.col("doc_id"), F.lit("lines")))
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # about TRAIN_DOCS ids

    def work(raw: list[bytes | None], kept: pa.RecordBatch) -> dict:
        good = [q != 0 for q in kept.column(1).to_pylist()]
        more = [plant(t) if g and t else (b"", []) for t, g in zip(raw, good, strict=True)]
        _, x, n_lines, n_words, lines = measure([*raw, *(t for t, _ in more)])
        ends = np.cumsum(n_lines)
        out: dict[str, list] = {"x": [], "lines": [], "words": [], "planted": [], "marks": [], "where": []}
        for i in range(len(raw)):
            own, copy = (slice(ends[k] - n_lines[k], ends[k]) for k in (i, len(raw) + i))
            out["x"].append(x[own].astype(np.float32).tobytes())
            out["lines"].append(lines[own].tobytes())
            out["words"].append(n_words[own].astype(np.int64).tobytes())
            out["planted"].append(x[copy].astype(np.float32).tobytes())
            out["marks"].append(lines[copy].tobytes() + np.array(more[i][1], dtype=np.uint64).tobytes())
            out["where"].append(0 < n_lines[i] <= DOC_LINES)
        return out

    got = map_texts(rows, "text", ["doc_id", "quality"], work, "x binary, lines binary, words binary, planted binary, marks binary").orderBy("doc_id", "x").collect()
    table_of = lambda b: np.frombuffer(b, dtype=np.float32).reshape(-1, N_FEATURES).astype(float)
    numbers = lambda b: np.frombuffer(b, dtype=np.uint64)
    seen: dict[int, set[int]] = {}
    for r in got:
        lines, words = numbers(r.lines), np.frombuffer(r.words, dtype=np.int64)
        longest = int(lines[words.argmax()])
        for h in lines[(words <= SHARED_WORDS) & (lines != longest)].tolist():
            seen.setdefault(h, set()).add(longest)
    shared = np.array(sorted(h for h, by in seen.items() if len(by) >= SHARED_BY), dtype=np.uint64)
    runs = []
    for r in got:
        marks = numbers(r.marks)
        for x, lines, planted in ((table_of(r.x), numbers(r.lines), 0), (table_of(r.planted), marks[: len(marks) // 2], marks[len(marks) // 2 :] > 0)):
            x[:, KNOWN] = np.isin(lines, shared)
            bad = np.full(len(x), r.quality == 0) | (x[:, KNOWN] > 0) | _menu(x) | planted
            runs += [(x[i : i + RUN_LINES], bad[i : i + RUN_LINES].astype(np.int64), (i == 0, i + RUN_LINES >= len(x))) for i in range(0, len(x), RUN_LINES)]
    return Model(crf.fit([x for x, _, _ in runs], [y for _, y, _ in runs], 2, ridge=2e-3, ends=[e for _, _, e in runs]), shared)


def labels_of(model: Model, x: np.ndarray, n_lines: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """1 for boilerplate, for every line of many texts."""
    f = model.field
    if not f.weights.any():
        return np.zeros(len(x), dtype=np.int64)
    return crf.viterbi(model.emit(x, lines), n_lines, f.trans, f.start, f.stop)


def label_lines(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the columns of ``OUT`` for every row; ``kept`` joins the base rules and the field's verdict."""

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        c, x, n_lines, line_words, lines = measure(raw)
        bad = labels_of(model, x, n_lines, lines) == 1
        total = run_sums(line_words, n_lines)
        content = run_sums(np.where(bad, 0, line_words), n_lines)
        share = content / np.maximum(total, 1)
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        return c | {"base_failed": failed, "n_lines": n_lines, "n_content_lines": run_sums((~bad).astype(np.int64), n_lines), "content_share": share, "kept": ~failed & (share >= CONTENT_SHARE)}

    return map_texts(documents, text, keep, work, OUT)


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return label_lines(documents, fit_lines(documents, table(spark, sf_dir, "labels")), ["doc_id"])
