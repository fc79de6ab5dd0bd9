"""A character tagger: bidirectional LSTM with CRF transitions, in numpy.

It learns from texts with labelled spans and gives scores for B- and I-tags of each kind. Training
is a few hundred steps over short windows, deterministic for its samples and settings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

WINDOW = 64
HIDDEN = 32
#: Characters: none, printable ASCII, white space, letters beyond ASCII, all others.
SYMBOLS = 99
_ids = np.full(0x250, 98, np.int16)
_ids[32:127] = np.arange(1, 96)
_ids[9:14] = 96
_ids[0xC0:0x250] = 97

Span = tuple[str, int, int]


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < len(_ids), _ids[np.minimum(codes, len(_ids) - 1)], 97).astype(np.int16)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    kinds: tuple[str, ...]
    weights: dict[str, np.ndarray]

    @property
    def tags(self) -> int:
        return 1 + 2 * len(self.kinds)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Scores (windows, characters, tags) of windows of symbols."""
        w = self.weights
        states = np.concatenate([run(ids, w, "f")[0], run(ids[:, ::-1], w, "b")[0][:, ::-1]], axis=2)
        return states @ w["out"] + w["out_bias"]

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (texts, characters) by the CRF; characters behind a length have no meaning."""
        steps = self.weights["next"] + forbidden(self.kinds)
        best = scores[:, 0].copy()
        back = np.zeros(scores.shape, np.int8)
        for t in range(1, scores.shape[1]):
            through = best[:, :, None] + steps
            back[:, t] = through.argmax(axis=1)
            best = np.where((t < lengths)[:, None], through.max(axis=1) + scores[:, t], best)
        tags = np.zeros(scores.shape[:2], np.int8)
        at = best.argmax(axis=1)
        rows = np.arange(len(scores))
        for t in range(scores.shape[1] - 1, -1, -1):
            inside = t < lengths
            tags[:, t] = at
            if t:
                at = np.where(inside, back[rows, t, at], at)
        return tags

    def spans(self, tags: np.ndarray, offset: int = 0) -> list[Span]:
        """Spans of a row of tags; one that opens with an I-tag goes on from before the row."""
        out, changes = [], np.flatnonzero(np.diff(tags, prepend=0, append=0) != 0)
        open_kind, start = 0, 0
        for t in [*changes.tolist(), len(tags)]:
            tag = int(tags[t]) if t < len(tags) else 0
            kind = (tag + 1) // 2
            if open_kind and (kind != open_kind or tag % 2 == 1):
                out.append((self.kinds[open_kind - 1], offset + start, offset + t))
                open_kind = 0
            if kind and not open_kind:
                open_kind, start = kind, t
        return out


def forbidden(kinds: Sequence[str]) -> np.ndarray:
    """-10000 for steps to an I-tag from other than its kind."""
    n = 1 + 2 * len(kinds)
    out = np.zeros((n, n), np.float32)
    for k in range(len(kinds)):
        inside = 2 * k + 2
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


def run(ids: np.ndarray, w: dict[str, np.ndarray], way: str) -> tuple[np.ndarray, list]:
    """Hidden states of one direction, and what the way back needs."""
    n, length = ids.shape
    hidden = w[way + "h"].shape[0]
    inputs = w[way + "x"]
    h = c = np.zeros((n, hidden), np.float32)
    states, kept = np.empty((n, length, hidden), np.float32), []
    for t in range(length):
        gates = inputs[ids[:, t]] + h @ w[way + "h"]
        gates[:, : 3 * hidden] *= 0.5
        np.tanh(gates, out=gates)
        gates[:, : 3 * hidden] *= 0.5
        gates[:, : 3 * hidden] += 0.5
        i, f, o, g = (gates[:, k * hidden : (k + 1) * hidden] for k in range(4))
        before = c
        c = f * before + i * g
        squashed = np.tanh(c)
        kept.append((h, before, gates, squashed))
        h = o * squashed
        states[:, t] = h
    return states, kept


def run_back(ids: np.ndarray, w: dict[str, np.ndarray], way: str, kept: list, slope: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Add the gradients of one direction, given that of its states."""
    hidden = slope.shape[2]
    dh = dc = np.zeros((len(ids), hidden), np.float32)
    for t in range(ids.shape[1] - 1, -1, -1):
        h, before, gates, squashed = kept[t]
        i, f, o, g = (gates[:, k * hidden : (k + 1) * hidden] for k in range(4))
        dh = dh + slope[:, t]
        dc = dc + dh * o * (1 - squashed**2)
        d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        # A product with ones where the symbol is; faster than adding row by row.
        out[way + "x"] += (ids[:, t] == np.arange(SYMBOLS)[:, None]).astype(np.float32) @ d
        out[way + "h"] += h.T @ d
        dh, dc = d @ w[way + "h"].T, dc * f


def crf_back(scores: np.ndarray, tags: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood, and its gradients by scores and steps."""
    n, length, k = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        x = forward[:, t - 1][:, :, None] + steps
        top = x.max(axis=1)
        forward[:, t] = scores[:, t] + top + np.log(np.exp(x - top[:, None]).sum(axis=1))
    for t in range(length - 2, -1, -1):
        x = steps[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
        top = x.max(axis=2)
        backward[:, t] = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
    last = forward[:, -1]
    total = last.max(axis=1) + np.log(np.exp(last - last.max(axis=1, keepdims=True)).sum(axis=1))
    d_scores = np.exp(forward + backward - total[:, None, None])
    pairs = np.exp(forward[:, :-1, :, None] + steps + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
    d_steps = pairs.sum(axis=(0, 1))
    rows, places = np.arange(n)[:, None], np.arange(length)
    path = scores[rows, places, tags].sum(axis=1) + steps[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    d_scores[rows, places, tags] -= 1
    np.subtract.at(d_steps, (tags[:, :-1], tags[:, 1:]), 1)
    return float((total - path).mean()), (d_scores / n).astype(np.float32), (d_steps / n).astype(np.float32)


def labelled_windows(samples: Sequence[tuple[str, Sequence[Span]]], kinds: Sequence[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A window of symbols and tags from a random place of each sample."""
    ids, tags = np.zeros((len(samples), WINDOW), np.int16), np.zeros((len(samples), WINDOW), np.int64)
    for row, (text, spans) in enumerate(samples):
        own = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            k = kinds.index(kind)
            own[start:end] = 2 * k + 2
            own[start] = 2 * k + 1
        # The window may begin before the text or end behind it.
        first = int(rng.integers(-WINDOW // 4, max(1, len(text) - WINDOW + WINDOW // 4)))
        a, b = max(first, 0), min(first + WINDOW, len(text))
        ids[row, a - first : b - first] = symbols(text)[a:b]
        tags[row, a - first : b - first] = own[a:b]
        if a == first and own[a] and own[a] % 2 == 0:
            tags[row, 0] -= 1  # a window that opens inside a span
    return ids, tags


def train(samples: Sequence[tuple[str, Sequence[Span]]], kinds: Sequence[str], steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Tagger:
    """Fit a tagger to texts with labelled spans (kind, start, end)."""
    kinds = tuple(kinds)
    rng = np.random.default_rng(seed)
    n_tags = 1 + 2 * len(kinds)
    w = {"out": rng.normal(0, 0.1, (2 * HIDDEN, n_tags)), "out_bias": np.zeros(n_tags), "next": np.zeros((n_tags, n_tags))}
    for way in "fb":
        w[way + "x"] = rng.normal(0, 0.1, (SYMBOLS, 4 * HIDDEN))
        w[way + "x"][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
        w[way + "h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
    w = {name: x.astype(np.float32) for name, x in w.items()}
    mean, square = ({name: np.zeros_like(x) for name, x in w.items()} for _ in range(2))
    closed = forbidden(kinds)
    for step in range(1, steps + 1):
        picked = rng.integers(0, len(samples), batch)
        ids, tags = labelled_windows([samples[i] for i in picked], kinds, rng)
        forward, kept_f = run(ids, w, "f")
        backward, kept_b = run(ids[:, ::-1], w, "b")
        states = np.concatenate([forward, backward[:, ::-1]], axis=2)
        scores = states @ w["out"] + w["out_bias"]
        _, d_scores, d_next = crf_back(scores, tags, w["next"] + closed)
        slope = {name: np.zeros_like(x) for name, x in w.items()}
        slope["next"], slope["out_bias"] = d_next, d_scores.sum(axis=(0, 1))
        slope["out"] = states.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, n_tags)
        d_states = d_scores @ w["out"].T
        run_back(ids, w, "f", kept_f, d_states[:, :, :HIDDEN], slope)
        run_back(ids[:, ::-1], w, "b", kept_b, d_states[:, ::-1, HIDDEN:], slope)
        norm = np.sqrt(sum(float((x**2).sum()) for x in slope.values()))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, x in slope.items():
            x = x * min(1.0, 5 / (norm + 1e-9))
            mean[name] += 0.1 * (x - mean[name])
            square[name] += 0.01 * (x * x - square[name])
            w[name] -= (pace * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Tagger(kinds, w)
