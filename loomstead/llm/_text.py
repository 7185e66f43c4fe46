"""Vectorised work on UTF-8 bytes: words, word hashes, windows.

A word is a run of characters other than U+0020 and U+0009 to U+000D.  All of
these are single bytes, so that words can be cut from the encoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
#: Bytes of a word that count for its place in ``SpanHasher.order``, and the powers they are weighted with.
ORDER_BYTES = 16
ORDER_POWERS = tuple(pow(_BASE, i + 1, 1 << 64) for i in range(ORDER_BYTES))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    """Extend the tables of powers to ``n`` places, by doubling."""
    global _powers, _inverses
    while len(_powers) < n:
        m = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_BASE, m, 1 << 64))])
        _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(_INVERSE, m, 1 << 64))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_arrays(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """Each text of an Arrow column as its bytes, without a copy; None for null."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        chunk = chunk.cast(pa.large_binary()) if not pa.types.is_large_binary(chunk.type) else chunk
        if len(chunk) == 0:
            continue
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        valid = chunk.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(chunk)):
            yield raw[at[i] : at[i + 1]] if valid[i] else None


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    edge = np.ones(len(buf) + 2, dtype=np.int8)
    edge[1:-1] = _SEPARATOR[buf]
    cuts = np.flatnonzero(edge[1:] != edge[:-1])
    return cuts[0::2], cuts[1::2]


class SpanHasher:
    """Hashes of spans of one text, from one pass over its bytes."""

    def __init__(self, buf: np.ndarray) -> None:
        _grow(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers[: len(buf)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes, equal for equal bytes anywhere."""
        return mix64((self.sums[ends] - self.sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


    def order(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each span by which spans can be ordered as if at random: the sum of (byte + 1) * base ** (place + 1) over its first ``ORDER_BYTES`` bytes, modulo 2**64."""
        return (self.sums[np.minimum(ends, starts + ORDER_BYTES)] - self.sums[starts]) * _inverses[starts] * np.uint64(_BASE)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes anywhere."""
    return SpanHasher(buf)(starts, ends)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all else as it is."""
    return _LOWER[buf]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += words[j : j + n] * (_PLACES[j % 5] + np.uint64(2 * (j // 5)))
    return mix64(out)


def shingle_set(buf: np.ndarray | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` lower-cased words.

    Texts with fewer words have one shingle, of all their words; texts without
    a word have none.
    """
    if buf is None or not len(buf):
        return np.zeros(0, dtype=np.uint64)
    buf = lowered(buf)
    starts, ends = word_spans(buf)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    words = span_hashes(buf, starts, ends)
    if len(words) < size:
        return mix64(window_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(words, size))


def in_steps(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what is made of one stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
