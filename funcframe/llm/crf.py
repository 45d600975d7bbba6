"""A two-part numpy linear-chain conditional random field: fitted on few sequences, decoded over ragged batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from funcframe.llm.common import adam


@dataclass
class Crf:
    """Scores: ``x @ weights`` for a token's label, ``trans[a, b]`` for b after a, ``start`` and ``stop`` at the ends."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(features: list[np.ndarray], labels: list[np.ndarray], n_labels: int, ridge: float = 1e-2, steps: int = 150, rate: float = 0.1, ends: list[tuple[bool, bool]] | None = None) -> Crf:
    """Maximum likelihood with an L2 penalty, by forward-backward over a padded batch of all sequences.

    ``ends``: whether a sequence has its real start and its real stop, where it is a run of a longer one.
    """
    width = features[0].shape[1] if features else 1
    zero = Crf(np.zeros((width, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), np.zeros(n_labels))
    ends = ends or [(True, True)] * len(features)
    rows = [(x, y) for x, y in zip(features, labels, strict=True) if len(x)]
    real_start, real_stop = np.array([e for x, e in zip(features, ends, strict=True) if len(x)], dtype=float).reshape(-1, 2).T[..., None]
    if not rows:
        return zero
    count, longest = len(rows), max(len(x) for x, _ in rows)
    x = np.zeros((count, longest, width))
    y = np.zeros((count, longest), dtype=np.int64)
    size = np.array([len(a) for a, _ in rows])
    for i, (a, b) in enumerate(rows):
        x[i, : len(a)], y[i, : len(a)] = a, b
    real = np.arange(longest)[None] < size[:, None]
    gold = np.eye(n_labels)[y] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    gold_trans = np.einsum("bti,btj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
    last = np.arange(count), size - 1
    tokens = real.sum()
    flat = x.reshape(-1, width)

    def gradient(w: list[np.ndarray]) -> list[np.ndarray]:
        weights, trans, start, stop = w
        stops = stop * real_stop
        emit = (flat @ weights).reshape(count, longest, n_labels)
        alpha = np.empty((count, longest, n_labels))
        beta = np.empty_like(alpha)
        alpha[:, 0] = start * real_start + emit[:, 0]
        step = np.exp(trans)

        def reach(score: np.ndarray, by: np.ndarray) -> np.ndarray:
            """log(exp(score) @ by) for each row."""
            top = score.max(1, keepdims=True)
            return np.log(np.exp(score - top) @ by + 1e-300) + top

        for t in range(1, longest):
            alpha[:, t] = np.where(real[:, t, None], reach(alpha[:, t - 1], step) + emit[:, t], alpha[:, t - 1])
        beta[:, -1] = stops
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], reach(emit[:, t + 1] + beta[:, t + 1], step.T), stops)
        log_z = _lse(alpha[:, -1] + stops, 1)
        node = np.exp(alpha + beta - log_z[:, None, None]) * real[..., None]
        left, right = alpha[:, :-1], emit[:, 1:] + beta[:, 1:]
        top_left, top_right = left.max(2, keepdims=True), right.max(2, keepdims=True)
        part = np.exp(left - top_left) * np.exp(top_left + top_right - log_z[:, None, None]) * both[..., None]
        g_trans = step * (part.reshape(-1, n_labels).T @ np.exp(right - top_right).reshape(-1, n_labels))
        d = node - gold
        return [
            flat.T @ d.reshape(-1, n_labels) / tokens + ridge * weights / width,
            (g_trans - gold_trans) / tokens + ridge * trans / n_labels,
            (d[:, 0] * real_start).sum(0) / tokens + ridge * start / n_labels,
            (d[last] * real_stop).sum(0) / tokens + ridge * stop / n_labels,
        ]

    return Crf(*adam(gradient, [zero.weights, zero.trans, zero.start, zero.stop], steps, rate))


def viterbi(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The best label of every token of many sequences that lie one after the other in ``emit``.

    All sequences step together, longest first, so that a step is one numpy operation over those still running. A tie
    goes to the lower label. Empty sequences are allowed.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    out = np.zeros(len(emit), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    running = np.searchsorted(-size, -np.arange(size[0]), side="left")
    back = np.zeros((len(emit), emit.shape[1]), dtype=np.int16)
    score = start + emit[first]
    for t in range(1, size[0]):
        n = running[t]
        at = first[:n] + t
        reach = score[:n, :, None] + trans
        back[at] = reach.argmax(1)
        score[:n] = reach.max(1) + emit[at]
    label = (score + stop).argmax(1)
    for t in range(size[0] - 1, -1, -1):
        n = running[t]
        at = first[:n] + t
        going = size[:n] > t + 1
        label[:n] = np.where(going, back[np.minimum(at + 1, len(emit) - 1), label[:n]], label[:n])
        out[at] = label[:n]
    return out


def decode_sparse(crf: Crf, emit: np.ndarray, lengths: np.ndarray, rest: int = 0) -> np.ndarray:
    """The same labels as :func:`viterbi`, by stepping only through tokens whose label is in doubt.

    A token for which ``rest`` beats every other label by more than all transitions around it could give back has that
    label on every best path, so the sequence falls into independent runs between such tokens.
    """
    trans, k = crf.trans, crf.trans.shape[0]
    gain_in = np.maximum((trans - trans[:, [rest]]).max(0), crf.start - crf.start[rest])
    gain_out = np.maximum((trans - trans[[rest], :]).max(1), crf.stop - crf.stop[rest])
    others = [j for j in range(k) if j != rest]
    doubt = ((emit[:, [rest]] - emit[:, others]) <= (gain_in + gain_out)[others]).any(1)
    out = np.full(len(emit), rest, dtype=np.int64)
    at = np.flatnonzero(doubt)
    if not len(at):
        return out
    seq = np.repeat(np.arange(len(lengths)), lengths)[at]
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(seq) > 0)])
    run = np.cumsum(new) - 1
    sizes = np.bincount(run)
    begins, ends = at[np.flatnonzero(new)], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    offsets = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    part = emit[at].copy()
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    at_start = begins == offsets[owner[begins]]
    at_stop = ends == (offsets + lengths)[owner[ends]] - 1
    part[heads] += np.where(at_start[:, None], crf.start, trans[rest])
    part[tails] += np.where(at_stop[:, None], crf.stop, trans[:, rest])
    none = np.zeros(k)
    out[at] = viterbi(part, sizes, trans, none, none)
    return out
