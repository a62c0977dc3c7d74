"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax.

Features of a text are its words, pairs of equal neighbouring words, and its 3- and 4-grams of
UTF-8 bytes (white space counts and so marks word ends), hashed into bucket ranges. Training is stochastic gradient
descent in numpy with AdaGrad step sizes; scores are calibrated on a part of the sample that
training does not see. For scoring, a vector's products with the softmax weights are folded into
one row for each bucket, since the average and the product commute.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _kernel as K

BITS = 16
BUCKETS = (3 << BITS) + 1
_MIX = np.uint32(0x9E3779B1)


def families(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket ids of each kind of feature, with row bounds (n + 1 long)."""
    starts, stops, first = K.word_bounds(buf, offsets)
    words = K.FIRST.slices(K.FIRST.prefix(K.FIRST.table[buf]), starts, stops)
    yield (words >> np.uint64(64 - BITS)).astype(np.int32), first
    # word pairs whose words are equal, whatever the word: one bucket
    same = np.flatnonzero(words[1:] == words[:-1]) + 1
    same = same[~np.isin(same, first)]
    yield np.full(len(same), 3 << BITS, dtype=np.int32), np.searchsorted(same, first)
    b = buf.astype(np.uint32)
    for n in (3, 4):
        count = max(0, len(b) - n + 1)
        code = np.zeros(count, dtype=np.uint32)
        for i in range(n):
            code = (code << np.uint32(8)) | b[i : i + count]
        # a gram belongs to the row where it starts, if it ends there too
        ok = np.ones(count, dtype=bool)
        for back in range(1, n):
            edge = offsets[1:] - back
            ok[edge[(edge >= 0) & (edge < count)]] = False
        at = np.flatnonzero(ok)
        yield (((code[at] * _MIX) >> np.uint32(32 - BITS)) + np.uint32((n - 2) << BITS)).astype(np.int32), np.searchsorted(at, offsets)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares."""
    buf = np.frombuffer((text or "").encode(), dtype=np.uint8)
    every = np.concatenate([f for f, _ in families(buf, np.array([0, len(buf)]))])
    ids, n = np.unique(every, return_counts=True)
    return ids, (n / max(1, len(every))).astype(np.float32)


def unseen(n: int) -> np.ndarray:
    """Which of n training texts only calibrate: every fifth one, if there are enough."""
    return np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, dtype=bool)


class SubwordModel:
    """Labels, folded bucket scores, bias, and calibration (scale, shift for each label)."""

    def __init__(self, labels: list, scores: np.ndarray, bias: np.ndarray, scale: float, shift: np.ndarray):
        self.labels, self.scores, self.bias, self.scale, self.shift = labels, scores, bias, scale, shift

    @classmethod
    def fit(cls, texts: list[str], labels: list, dim: int = 12, epochs: int = 6, rate: float = 0.3, seed: int = 7) -> SubwordModel:
        """Trains on the texts in an order that the seed fixes; every fifth one only calibrates."""
        names = sorted(set(labels))
        y = np.array([names.index(x) for x in labels], dtype=np.int64)
        rng = np.random.default_rng(seed)
        held = unseen(len(texts))
        bags = [bag(t) for t in texts]
        emb = rng.uniform(-0.5, 0.5, (BUCKETS, dim)).astype(np.float32) / dim
        out = np.zeros((dim, len(names)), dtype=np.float32)
        bias = np.zeros(len(names), dtype=np.float32)
        ge, go = np.full((BUCKETS, 1), 1e-8, np.float32), np.full_like(out, 1e-8)
        gb = np.full_like(bias, 1e-8)
        train = np.flatnonzero(~held)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(train):
                ids, w = bags[i]
                h = w @ emb[ids] if len(ids) else np.zeros(dim, np.float32)
                z = h @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                gh = out @ p
                g = np.outer(h, p)
                go += g * g
                gb += p * p
                out -= step * g / np.sqrt(go)
                bias -= step * p / np.sqrt(gb)
                if len(ids):
                    gw = w[:, None] * gh
                    ge[ids] += (gw * gw).mean(axis=1, keepdims=True)
                    emb[ids] -= step * gw / np.sqrt(ge[ids])
        scores = (emb @ out).astype(np.float32)
        model = cls(names, scores, bias, 1.0, np.zeros(len(names)))
        model._calibrate([bags[i] for i in np.flatnonzero(held)], y[held])
        return model

    def _calibrate(self, bags, y: np.ndarray) -> None:
        """Temperature and label shifts by gradient steps on the likelihood of unseen texts."""
        if len(set(y.tolist())) < 2:
            return
        z = np.array([w @ self.scores[ids] + self.bias if len(ids) else self.bias for ids, w in bags], dtype=np.float64)
        scale, shift = 1.0, np.zeros(z.shape[1])
        for _ in range(400):
            e = scale * z + shift
            p = np.exp(e - e.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            scale -= 0.2 * ((p * z).sum(axis=1).mean() + 0.002 * (scale - 1))
            shift -= 0.2 * (p.mean(axis=0) + 0.002 * shift)
            scale = max(scale, 0.05)
        self.scale, self.shift = float(scale), shift

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """One row of label probabilities for each text; whole texts, in pieces of bounded size."""
        out = np.empty((len(texts), len(self.labels)))
        # two labels need only their difference
        table = np.ascontiguousarray(self.scores[:, 1] - self.scores[:, 0])[:, None] if len(self.labels) == 2 else self.scores
        for r0, r1, buf, offsets in K.pieces(texts, 1 << 19):
            n, sums = np.zeros(r1 - r0, np.int64), np.zeros((r1 - r0, table.shape[1]))
            for f, bounds in families(buf, offsets):
                size = np.diff(bounds)
                n += size
                if len(full := np.flatnonzero(size)):
                    sums[full] += np.add.reduceat(table[f], bounds[full], axis=0, dtype=np.float64)
            mean = sums / np.maximum(n, 1)[:, None]
            if len(self.labels) == 2:
                mean = np.concatenate([np.zeros_like(mean), mean], axis=1)
            e = self.scale * (mean + self.bias) + self.shift
            e = np.exp(e - e.max(axis=1, keepdims=True))
            out[r0:r1] = e / e.sum(axis=1, keepdims=True)
        return out
