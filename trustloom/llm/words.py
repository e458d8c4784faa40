"""Words and their fingerprints for a whole Arrow column at once, by numpy on the UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible 64-bit numbers."""
    return mix(np.uint64(seed) + _GOLDEN * np.arange(1, n + 1, dtype=np.uint64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were ever needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(1 << 16, 1 << (int(n) - 1).bit_length())
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)])
                for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(0xD1342543DE82EF95)
_WORD_POWERS = (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))


class Splitter:
    """Which bytes separate words, and which bytes count as which others."""

    def __init__(self, separators: bytes, fold: bytes = bytes(range(256))):
        self.separates = np.zeros(256, dtype=bool)
        self.separates[list(separators)] = True
        self.value = numbered(11, 256)[np.frombuffer(fold, dtype=np.uint8)]


WHITE_SPACE = Splitter(b" \t\n\v\f\r")
# ASCII that is neither digit nor letter separates, and A-Z count as a-z.
LOWER_WORDS = Splitter(
    bytes(b for b in range(128) if not (chr(b).isdigit() or chr(b).isalpha())),
    bytes(range(256)).lower())


class Words(NamedTuple):
    """The words of some texts, one after the other: where each begins and ends in ``data``, its fingerprint, and the
    first word of each text (one more entry than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    print: np.ndarray
    first: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (one more entry than texts). Nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, splitter: Splitter) -> Words:
    data, offsets = text_bytes(texts)
    inside = ~splitter.separates[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a text ends the word before it
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    prints = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):  # in slices, so that memory stays small beside the text
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES)))
        lo, hi = start[at], end[to - 1]
        up, down = _BYTE_POWERS(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(splitter.value[data[lo:hi]] * up, out=sums[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        prints[at:to] = mix((sums[e] - sums[s]) * down[s] + _GOLDEN * (e - s).astype(np.uint64))
        at = to
    return Words(data, start, end, prints, np.searchsorted(start, offsets))


def window_prints(prints: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A fingerprint for each run of ``size`` words, by the place of its first word; ``which``: one of two independent
    ones."""
    n = len(prints) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORD_POWERS[which](len(prints))
    sums = np.zeros(len(prints) + 1, dtype=np.uint64)
    np.cumsum(prints * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer text alone), to bound what numpy allocates."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < len(lengths):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers wait for the next one with what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
