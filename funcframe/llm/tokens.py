"""Token ids of whole texts under a word-level BPE vocabulary, by a cache of its words."""

from __future__ import annotations

import struct
import unicodedata

import numpy as np

#: Words, and as many of their parts, whose ids a worker remembers; those not used since it was last full go first.
HELD = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 for itself, other bytes from 256 upward."""
    out, other = {}, 256
    for b in range(256):
        if 33 <= b < 127 or 161 <= b < 173 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(other)
            other += 1
    return out


class WordTokenizer:
    """Ids of a text as ``tokenizers`` gives them (no special tokens added), packed as little-endian ``dtype``.

    The vocabulary's splitter never joins across ASCII white space, so a text's ids are those of its runs between white
    space, one after the other. Runs of letters below U+0250 with ASCII signs behind go straight to the BPE model; every
    other run passes the whole tokenizer.
    """

    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path or default_path())
        self.model = self.full.model
        self.letters = _byte_letters()
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        self.runs: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_runs: dict[bytes, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def pack(self, *ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = self.old_parts.get(part)
            if got is None:
                stand_in = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                got = self.pack(*[t.id for t in self.model.tokenize(stand_in)])
            self.parts[part] = got
        return got

    def _run(self, run: bytes) -> bytes:
        ids = self.old_runs.get(run)
        if ids is not None:
            self.runs[run] = ids
            return ids
        text = run.decode()
        core = text.rstrip(".,;:!?*$%&#")
        low = core.lower()
        if core.isalpha() and (low.isascii() or (max(low) < "ɐ" and "İ" not in core and unicodedata.is_normalized("NFC", text))):
            ids = self._part(low)
            if len(core) < len(text):
                ids += self._part(text[len(core) :])
        else:
            ids = self.pack(*self.full.encode(text, add_special_tokens=False).ids)
        if len(run) <= 64:
            self.runs[run] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if len(self.runs) > HELD:
            self.old_runs, self.runs = self.runs, {}
        if len(self.parts) > HELD:
            self.old_parts, self.parts = self.parts, {}
        get, make = self.runs.get, self._run
        return b"".join([got if (got := get(r)) is not None else make(r) for r in text.split()])


_HELD: dict[str | None, WordTokenizer] = {}


def tokenizer(path: str | None = None) -> WordTokenizer:
    """One for each path and worker process."""
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]
