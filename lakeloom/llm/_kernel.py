"""Numpy kernels on Arrow text batches: word bounds, word hashes, digests, and winnowed window anchors.

Word hashes are chained over eight bytes at a time. The hashes of grams are polynomial over these
(mod 2**64, odd base), so the hash of any slice comes from two prefix values; they choose anchors
and group rows, but are never taken for equality of texts. Where that counts, 128-bit BLAKE2b
digests of the very bytes are compared.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Longer words are hashed one by one.
LONG = 64
#: Text is worked on in pieces of about this many bytes, so that scratch arrays stay small.
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Family:
    """One hash family: a byte table, an odd base, and its powers both ways, grown on demand."""

    def __init__(self, seed: int):
        draw = mix64((np.arange(1, 258, dtype=np.uint64) + U64(seed * 1000)) * U64(0x9E3779B97F4A7C15))
        self.table = draw[:256]
        self.base = int(draw[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), PIECE)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down

    def prefix(self, units: np.ndarray) -> np.ndarray:
        """Prefix sums of uint64 units; length n + 1."""
        up, _ = self.powers(len(units) + 1)
        out = np.zeros(len(units) + 1, dtype=U64)
        np.cumsum(units * up[: len(units)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of units[start:stop], for arrays of bounds."""
        _, down = self.powers(len(prefix))
        return mix64((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(U64))


FIRST = Family(1)


def pieces(texts: pa.Array, most: int = PIECE):
    """Yields (first row, last row + 1, bytes, offsets) for runs of rows of about `most` bytes.

    Null texts count as empty. A longer row is a piece of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, n = 0, len(texts)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + most, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of words `[^\\x20\\x09-\\x0D]+` in bytes, and each row's first word index (n + 1 long)."""
    solid = ~_SPACE[buf]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = solid
    before[offsets] = False  # a row starts afresh
    after = np.zeros(len(buf) + 1, dtype=bool)
    after[:-1] = solid
    after[offsets] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    stops = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    size = stops - starts
    eight = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(8, np.uint8)), 8)
    out = mix64(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(size <= LONG)
    for r in range(0, LONG, 8):
        rows = rows[size[rows] > r]
        if not len(rows):
            break
        x = np.ascontiguousarray(eight[starts[rows] + r]).view(U64).ravel()
        x &= U64(_MASK) >> (U64(8) * np.maximum(8 - (size[rows] - r), 0).astype(U64))  # bytes of the word only
        out[rows] = mix64(out[rows] ^ x)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(buf[starts[i] : stops[i]], digest_size=8).digest(), "little")
    return out


def single_spaced(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words one space apart, as bytes, and where each starts and stops there."""
    size = stops - starts
    new = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    solid = np.zeros(len(buf) + 1, dtype=np.int8)
    solid[starts] += 1
    solid[stops] -= 1
    to = np.ones(len(out), dtype=bool)
    to[new + size] = False
    out[to] = buf[np.cumsum(solid[:-1]) > 0]
    return out.tobytes(), new, new + size


def digests(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit BLAKE2b of data[start:stop], as two arrays of longs."""
    raw = b"".join(blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True))
    pair = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i + w] for each i, in O(n) by block prefixes and suffixes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=U64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def window_anchors(units: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Winnowed anchors of all `window`-unit windows that lie in one row.

    Each window is represented by its leftmost minimal `gram`-unit hash, which depends on the
    window's content only: equal windows have their anchors at equal offsets. Neighbouring
    windows with one anchor form a stretch. Returns (row, anchor, first, last, fp): the window
    starts `first..last` (inclusive) share the anchor; fp hashes the gram.
    """
    n = len(units)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none, none.astype(U64)
    p1 = FIRST.prefix(units)
    at = np.arange(n - gram + 1)
    grams = FIRST.slices(p1, at, at + gram)
    keys = ((grams >> U64(32)) << U64(32)) | at.astype(U64)
    least = sliding_min(keys, window - gram + 1)
    # rows that hold at least one window: their window starts, laid end to end
    size = np.diff(bounds)
    rows = np.flatnonzero(size >= window)
    if not len(rows):
        return none, none, none, none, none.astype(U64)
    ok = np.zeros(n + 1, dtype=np.int8)
    ok[bounds[rows]] += 1
    ok[bounds[rows + 1] - window + 1] -= 1
    starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    anchor = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(starts) != 1)) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(starts)]]) - 1
    a, first, last = anchor[begin], starts[begin], starts[end]
    row = np.searchsorted(bounds, a, side="right") - 1
    return row, a, first, last, mix64(grams[a])


def word_units(buf: np.ndarray, offsets: np.ndarray):
    """Word hashes as units, their byte starts and stops, and row bounds in words."""
    starts, stops, bounds = word_bounds(buf, offsets)
    return word_hashes(buf, starts, stops), starts, stops, bounds


def byte_units(buf: np.ndarray) -> np.ndarray:
    return FIRST.table[buf]
