"""Personal data: exact patterns, and a conditional random field over word shapes that adds what they miss.

Defined cases. A null text counts as empty and has no spans. Repeated rows get equal results; an empty table gives an
empty result; only the id and text columns are read. Ties between labels go to no span. Punctuation at a word's edge ends a
span of the field. What the patterns' spans cover of it is taken out and the rest stays; of words that this cuts, the field
judges the rest anew. All scans are linear in the text, so one very long word or text is no special case.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from funcframe.llm import crf
from funcframe.llm.bytesof import Words, member, words_of
from funcframe.llm.common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile("[^0-9]+")
_SAYS = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and dotted domain; each ``@`` can only belong to the run before it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four patterns, by start and then by kind, in code points."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Word shapes

_CLASSES = ("edge", "lower", "capital", "upper", "digits", "long digits", "at", "dotted", "plus", "bracket", "mixed", "other", "zero digits", "said at", "said dot", "four digits")
N_CLASS = len(_CLASSES)
N_OWN = 38
#: Words of letters alone that have a shape of their own.
_SAID = (b"at", b"dot")
_FOURS = re.compile(rb"[0-9]{4}([.-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}")
_THREES = re.compile(rb"[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}")
_SMALL = re.compile(rb"[0-9]{1,2}(?:[./:-][0-9]{1,2})+|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}")
_AREA = re.compile(rb"0[0-9]{1,4}[/-][0-9]{5,9}")
_QUAD = re.compile(rb"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")
_BOOK = re.compile(rb"97[89][0-9]{10}|97[89]-[0-9-]{14}")
_ANY_SAID = re.compile(rb"[(\[{<_-](?:at|dot)[)\]}>_-]", re.I)
_DIGITS, _NOT_LETTER = b"0123456789", bytes([*range(65), *range(91, 97), *range(123, 128)])
N_FEATURES = N_OWN + 2 * N_CLASS
_TRIM = b".,;:!?\"'*$%&#|<>"
_EDGE = _TRIM + b" \t\n\x0b\x0c\r"
_LETTER = member(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_UPPER, _LOWER, _TRIMMED = member(bytes(range(65, 91))), member(bytes(range(97, 123))), member(_TRIM)
_HAS = [b"@", b".", b"-", b"(", b")", b"+", b"=", b"/", b":", b"_"]


def shape(word: bytes) -> tuple[np.ndarray, int]:
    """What the field sees of a word, all of it: its own features and the class that its neighbours see."""
    core = word.strip(_TRIM) or word
    n = len(core)
    digits = n - len(core.translate(None, _DIGITS))
    letters = len(core.translate(None, _NOT_LETTER))
    x = np.zeros(N_OWN)
    x[0] = 1
    x[1] = letters == n
    x[2] = digits == n
    x[3] = min(digits, 20) / 10
    x[4] = letters / max(n, 1)
    x[5] = min(n, 24) / 12
    for i, sign in enumerate(_HAS):
        x[6 + i] = sign in core
    x[16] = _QUAD.fullmatch(core) is not None
    x[17] = b"@" in core[1:] and b"." in core[core.find(b"@") :]
    x[18] = 14 <= digits <= 19 and digits == n
    x[19] = core[:1] == b"+" and digits > 0
    x[20] = core[:1] == b"(" and core[-1:] == b")" and 2 <= digits <= 5 and digits == n - 2
    x[21] = b"-" in core and letters == 0 and 6 <= digits <= 8
    x[22] = digits > 0 and letters > 0 and b"@" not in core
    x[23] = 1 <= digits <= 4 and digits == n
    x[24] = digits == 4 and digits == n
    x[25] = _ANY_SAID.search(core) is not None
    x[26] = _FOURS.fullmatch(core) is not None
    x[27] = _THREES.fullmatch(core) is not None
    x[28] = _SMALL.fullmatch(core) is not None
    x[29] = _AREA.fullmatch(core) is not None
    x[30] = _BOOK.fullmatch(core) is not None
    x[31] = digits == n and 2 <= n <= 5 and core[:1] == b"0"
    x[32] = digits == n and 6 <= n <= 9
    x[33] = digits == n and 10 <= n <= 13
    x[34] = letters == 0 and core.count(b".") > 0 and not x[16]
    said = core.lower()
    x[35], x[36] = (said == w for w in _SAID)
    x[37] = x[25] and digits == 0
    if said in _SAID:
        kind = "said " + said.decode()
    elif letters == n:
        kind = "upper" if core.isupper() else "capital" if core[:1].isupper() else "lower"
    elif b"@" in core:
        kind = "at"
    elif core[:1] == b"+":
        kind = "plus"
    elif core[:1] == b"(":
        kind = "bracket"
    elif digits == n:
        kind = "zero digits" if x[31] else "four digits" if n == 4 else "long digits" if n > 5 else "digits"
    elif b"." in core and letters == 0:
        kind = "dotted"
    else:
        kind = "mixed" if digits else "other"
    return x, _CLASSES.index(kind)


def features(words: list[bytes]) -> np.ndarray:
    """Dense features of a short sequence, for fitting."""
    got = [shape(w) for w in words]
    x = np.zeros((len(words), N_FEATURES))
    kind = [0, *(k for _, k in got), 0]
    for i, (own, _) in enumerate(got):
        x[i, :N_OWN] = own
        x[i, N_OWN + kind[i]] = 1
        x[i, N_OWN + N_CLASS + kind[i + 2]] = 1
    return x


#: The small labelled table: {kind:words} marks personal data, %d stands for a digit and %h for a hexadecimal one.
PATTERNS = (
    "{email:%w.%d%d@mail%d.example.com}", "{email:%w_%w@%w.org}", "{email:%w@%w.co.uk}", "{email:%w(at)%w.com}", "{email:%w[at]%w[dot]net}",
    "{email:%w dot %w at %w dot com}", "{email:%w at %w dot org}", "{email:%w (at) %w (dot) net}", "{email:%w%d%d at %w dot com}",
    "{ip:%d%d%d.%d%d.%d%d%d.%d%d}", "{ip:%d%d.%d%d%d.%d.%d%d%d}", "{ip:%d%d%d.%d%d%d.%d%d.%d}",
    "{card:%d%d%d%d%d%d%d%d%d%d%d%d%d%d%d%d}", "{card:%d%d%d%d %d%d%d%d %d%d%d%d %d%d%d%d}", "{card:%d%d%d%d-%d%d%d%d-%d%d%d%d-%d%d%d%d}", "{card:%d%d%d%d%d%d%d%d%d%d%d%d%d%d%d}", "{card:%d%d%d%d.%d%d%d%d.%d%d%d%d.%d%d%d%d}",
    "{phone:+%d (%d%d%d) %d%d%d-%d%d%d%d}", "{phone:(%d%d%d) %d%d%d-%d%d%d%d}", "{phone:+%d%d %d%d %d%d%d %d%d%d%d}", "{phone:%d%d%d-%d%d%d-%d%d%d%d}",
    "{phone:%d%d%d.%d%d%d.%d%d%d%d}", "{phone:0%d%d %d%d%d%d%d%d%d%d}", "{phone:0%d%d%d/%d%d%d%d%d%d%d}", "{phone:0%d%d-%d%d%d%d%d%d%d}", "{phone:(0%d%d) %d%d%d%d%d%d%d}", "{phone:0%d%d%d %d%d%d%d%d%d%d}",
    'token = "%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h%h"', "version %d.%d.", "License, Version %d.%d.", "CC BY-NC %d.%d.", "in %d%d%d%d", "%d%d%d%d-%d%d-%d%d",
    "%d%d:%d%d", "no. %d%d", "$%d%d.%d%d", "%d%d,%d%d%d", "%d%d%", "page %d%d%d", "%d/%d/%d%d%d%d", "@%w", "%w/%w", "section %d.%d.%d", "+ %d", "(%d)", "(%w %w)", "%d%d%d%d%d", "x%d", "%w-%w", "%W", "%w=%d",
    "978%d%d%d%d%d%d%d%d%d%d", "ISBN 979%d%d%d%d%d%d%d%d%d%d", "978-%d-%d%d%d%d-%d%d%d%d-%d", "%d%d-0-0-%d", "%d-%d", "%d%d-%d%d", "%d.%d.%d", "%d%d.%d%d.%d%d%d%d", "%d%d:%d%d-%d%d:%d%d", "%d-%d-%d-%d",
    "%d%d%d%d %d%d%d%d", "%d,%d%d%d,%d%d%d", "%d%d %d%d %d%d", "no. %d%d%d%d%d%d%d", "%d%d%d%d%d%d%d%d%d%d%d%d", "0%d", "0.%d%d", "%d%d%d %d%d%d", "%d%d%d%d/%d%d", "v%d.%d.%d.%d%d", "%d%d%d%d-%d%d%d%d",
    "%w at %w", "%W at %d%d:%d%d", "at %w %w", "%w at the %w", "a dot %w", "(%w at %w)", "(%w %w at %w %w)", "(at %w)", "%w at the dot on %w", "%w at the dot %w %w", "the dot %w %w", "%w dot %w", "at %w at %w", "%w. At %w %w", "%w (%w) %w", "in %d%d%d%d at %w", "(%d%d)", "(%d%d%d%d)", "%w(%w)", "%w.%w", "%d%d%d%d%d%d%d%d", "%d%d%d%d%d%d", "%d%d%d %w", "0%d%d %w",
)
FILLERS = ("%w %w", "%w. %w", "%W %w", "%w, %w %w", "%w%w", "%w!!", "%w***", "%W%W!!", "%w | %w", "%w&&&")


def labelled_table(copies: int = 10, seed: int = 7, patterns: tuple[str, ...] = PATTERNS) -> list[tuple[list[bytes], list[int]]]:
    """Sequences of words and labels: each pattern filled ``copies`` times between neutral words, the same each time."""
    rng = np.random.default_rng(seed)
    pieces = ["th", "er", "on", "an", "re", "he", "in", "ed", "sch", "ung", "ción", "eau", "que", "är", "mi", "la"]

    def fill(form: str) -> str:
        word = lambda: "".join(rng.choice(pieces, rng.integers(1, 5)))
        form = re.sub("%d", lambda _: str(rng.integers(10)), form)
        form = re.sub("%h", lambda _: "0123456789abcdef"[rng.integers(16)], form)
        return re.sub("%w", lambda _: word(), re.sub("%W", lambda _: word().capitalize(), form))

    rows = []
    for form in patterns * copies:
        m = re.fullmatch(r"\{(\w+):(.*)\}", form)
        marked = fill(m[2] if m else form).encode().split()
        before, after = (fill(str(rng.choice(FILLERS))).encode().split() for _ in range(2))
        tail = str(rng.choice(["", "", "", ".", ",", "!!", "###", "%%%"])).encode()
        marked[-1] += tail
        lab = LABELS.index(m[1]) if m else 0
        rows.append(([*before, *marked, *after], [0] * len(before) + [lab] * len(marked) + [0] * len(after)))
    return rows


def fit_shapes() -> crf.Crf:
    rows = labelled_table()
    return crf.fit([features(w) for w, _ in rows], [np.array(y) for _, y in rows], len(LABELS), ridge=2e-3, steps=250)


class Tagger:
    """Adds the field's spans. Words of letters alone have one of few shapes; scores of the others are kept, up to a bound."""

    HELD, LONGEST = 200_000, 64

    def __init__(self, model: crf.Crf) -> None:
        self.model = model
        self.codes: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []
        self.kinds: list[int] = []
        for letters in (b"x", b"Xx", b"X"):  # the code of a plain word is its case times LONGEST and its length
            for n in range(self.LONGEST):
                self._add((letters + letters[-1:] * n)[: n + 1])
        for word in _SAID:
            self._add(word)
        self.fixed = len(self.rows)

    def _add(self, word: bytes) -> int:
        own, kind = shape(word)
        self.rows.append(own @ self.model.weights[:N_OWN])
        self.kinds.append(kind)
        return len(self.rows) - 1

    def _codes(self, w: Words) -> np.ndarray:
        if len(self.codes) > self.HELD:
            del self.rows[self.fixed :], self.kinds[self.fixed :]
            self.codes = {}
        data = w.data
        letter = _LETTER[data]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        letters, upper = w.total(letter), w.total(_UPPER[data])
        plain = (letters > 0) & (letters + w.total(_TRIMMED[data]) == w.end - w.begin) & (w.total(first) == 1)
        lower = w.total(_LOWER[data])
        head = w.begin.copy()
        lead = np.flatnonzero(plain & ~letter[np.minimum(head, len(data) - 1)])
        for i in lead:
            while not letter[head[i]]:
                head[i] += 1
        case = np.where((upper > 0) & (lower == 0), 2, np.where(_UPPER[data[head]], 1, 0))
        codes = case * self.LONGEST + np.minimum(letters, self.LONGEST) - 1
        for k, said in enumerate(_SAID):
            i = np.flatnonzero(plain & (letters == len(said)))
            same = np.all([data[head[i] + j] | 32 == c for j, c in enumerate(said)], axis=0)
            codes[i[same]] = 3 * self.LONGEST + k
        joined = data.tobytes()
        for i in np.flatnonzero(~plain):
            word = joined[w.begin[i] : w.end[i]]
            code = self.codes.get(word)
            if code is None:
                code = self._add(word)
                if len(word) <= 200:
                    self.codes[word] = code
            codes[i] = code
        return codes

    def spans(self, raw: list[bytes]) -> list[list[tuple[int, int, str]]]:
        """For each text the spans in bytes, in order."""
        w = words_of(raw)
        code = self._codes(w)
        lengths = w.counts
        out: list[list[tuple[int, int, str]]] = [[] for _ in raw]
        if not len(code):
            return out
        kinds = np.array(self.kinds)[code]
        first = np.zeros(len(code), dtype=bool)
        ends = np.cumsum(lengths)
        first[(ends - lengths)[lengths > 0]] = True
        last = np.zeros(len(code), dtype=bool)
        last[ends[lengths > 0] - 1] = True
        weights = self.model.weights
        emit = np.array(self.rows)[code]
        emit += weights[N_OWN : N_OWN + N_CLASS][np.where(first, 0, np.roll(kinds, 1))]
        emit += weights[N_OWN + N_CLASS :][np.where(last, 0, np.roll(kinds, -1))]
        label = crf.decode_sparse(self.model, emit, lengths)
        hit = np.flatnonzero(label)
        for i in np.unique(np.searchsorted(ends, hit, side="right")):
            base = ends[i] - lengths[i]
            own = label[base : ends[i]]
            run: list = []
            for k, m in enumerate(_WORDS.finditer(raw[i])):
                if own[k]:
                    a, b = _core(raw[i], m.start(), m.end())
                    if run and run[3] == k and run[2] == own[k] and a == m.start():
                        run[1] = b
                    else:
                        if run:
                            out[i].append((run[0], run[1], LABELS[run[2]]))
                        run = [a, b, own[k], k]
                    run[3] = k + 1 if a < b == m.end() else -1  # the word that may follow in the run
            if run:
                out[i].append((run[0], run[1], LABELS[run[2]]))
        return out


def _core(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The part without white space and trimmed signs at its edges."""
    word = raw[a:b].lstrip(_EDGE)
    return b - len(word), b - len(word) + len(word.rstrip(_EDGE))


class Places:
    """Places in bytes for places in code points, and back."""

    def __init__(self, raw: bytes, text: str) -> None:
        self.at = None
        if len(raw) != len(text):
            self.at = np.append(np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80), len(raw))

    def bytes_of(self, i: int) -> int:
        return i if self.at is None else int(self.at[i])

    def points_of(self, i: int) -> int:
        return i if self.at is None else int(np.searchsorted(self.at, i))


def outside(a: int, b: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a range without those covered, which are sorted and disjoint."""
    out = []
    for s, e in covered[bisect_right(covered, a, key=lambda c: c[1]) :]:
        if s >= b:
            break
        if s > a:
            out.append((a, s))
        a = max(a, e)
    return [*out, (a, b)] if a < b else out


def cut_words(raw: bytes, x: int, y: int, left: bool, right: bool) -> tuple[int, int]:
    """The end of the cut word at the start of a piece and the start of the one at its end; those of the piece if not cut."""
    head, tail = x, y
    if left and not raw[x - 1 : x].isspace():
        m = _WORDS.match(raw, x, y)
        head = m.end() if m else x
    if right and head < y and not raw[y : y + 1].isspace():
        tail = max(head, x + len(raw[x:y]) - len(raw[x:y].split()[-1])) if not raw[y - 1 : y].isspace() else y
    return head, tail


def _joined(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of one kind with nothing but white space between them become one."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans):
        if out and out[-1][2] == kind and not raw[out[-1][1] : a].strip():
            out[-1] = (out[-1][0], b, kind)
        else:
            out.append((a, b, kind))
    return out


OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _tagged(tagger: Tagger, raw: list[bytes | None]):
    """For each text the text, the patterns' spans, and these with what the field adds, by start and then by kind."""
    texts = [t or b"" for t in raw]
    held, asked = [], []
    for t, added in zip(texts, tagger.spans(texts), strict=True):
        text = t.decode()
        base = base_spans(text) if any(c in t for c in (b"@", b"+")) or re.search(rb"[0-9]", t) else []
        places = Places(t, text) if added else None
        covered: list[tuple[int, int]] = []
        for s, e, _ in base if added else ():
            s, e = places.bytes_of(s), places.bytes_of(e)
            if covered and s <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(covered[-1][1], e))
            else:
                covered.append((s, e))
        pieces = []
        for a, b, kind in added:
            for x, y in outside(a, b, covered):
                head, tail = cut_words(t, x, y, x > a, y < b)
                pieces.append((x, head, tail, y, kind, len(asked)))
                if _SAYS.search(t, x, head) or _SAYS.search(t, tail, y):
                    asked.append(t[x:y])
                else:
                    pieces[-1] = (*pieces[-1][:5], None)
        held.append((t, text, base, places, pieces))
    told = tagger.spans(asked)
    for t, text, base, places, pieces in held:
        taken = list(base)
        for x, head, tail, y, kind, ask in pieces:
            got = [(*_core(t, head, tail), kind)]
            for p, q, k in [] if ask is None else told[ask]:
                got += [(*_core(t, max(x + p, lo), min(x + q, hi)), k) for lo, hi in ((x, head), (tail, y)) if max(x + p, lo) < min(x + q, hi)]
            taken += [(places.points_of(a), places.points_of(b), k) for a, b, k in _joined(t, [g for g in got if g[0] < g[1]])]
        yield text, base, sorted(taken, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_TAGGERS: dict[bytes, Tagger] = {}


def _tagger(model: crf.Crf) -> Tagger:
    """One for each model and worker process."""
    key = model.weights.tobytes()
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(model)
    return _TAGGERS[key]


def find(documents: DataFrame, keep: list[str], text: str = "text", model: crf.Crf | None = None) -> DataFrame:
    """``keep`` and the columns of ``OUT``: spans as kind:start:end in code points, the end exclusive."""
    model = model or fit_shapes()

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in OUT.split(", ")}
        for _, base, spans in _tagged(_tagger(model), raw):
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for *_, k in base))
            out["base_sha256"].append(hashlib.sha256(_told(base).encode()).hexdigest())
            out["spans"].append(_told(spans))
            out["n_added"].append(len(spans) - len(base))
        return out

    return map_texts(documents, text, keep, work, OUT)


def redact(documents: DataFrame, text: str = "text", model: crf.Crf | None = None) -> DataFrame:
    """The same rows and columns; each span, or run of spans that overlap, becomes its first kind in angle brackets."""
    model = model or fit_shapes()

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        done: list[str | None] = []
        for was, (t, _, spans) in zip(raw, _tagged(_tagger(model), raw), strict=True):
            parts, free = [], 0
            for a, b, kind in spans:
                if a >= free:
                    parts += [t[free:a], f"<{kind}>"]
                free = max(free, b)
            done.append(None if was is None else "".join([*parts, t[free:]]))
        return {"redacted_in_work": done}

    keep = [c for c in documents.columns if c != text]
    got = map_texts(documents, text, keep, work, "redacted_in_work string")
    return got.toDF(*keep, text).select(*[f"`{c}`" for c in documents.columns])


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), ["doc_id"])
