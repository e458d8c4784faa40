"""Counts of pairs of words, packed by cells of words: a few arrays in place of a row a pair.

Every pair counts for both its words. A cell has the pairs of the words ``a`` with the same ``a % cells``, so the frequent
words are in different cells. Within a cell, pairs are ordered by batch, range of the partner, word and partner, and a
pair is one number that grows in this order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Entries as they are counted, by cell: words in the order of ``Cells`` and how many entries each has, then of all entries
# the partner's place in its range and how often both stood in a true pair, then in a drawn one.
COUNTED = "cell bigint, words binary, sizes binary, partners binary, times binary"
# The same of one batch and of one range of words and partners; words are ids.
PACKED = "words binary, sizes binary, partners binary, times binary, batch int, at_a int, at_b int"
FIELDS = ["words", "sizes", "partners", "times"]
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Cells:
    """The ids [0, ``words``) in ``cells`` cells, both directions of a pair in one of ``batches`` batches, partners in
    ranges of ``held`` ids (less than 2^32). Numbers of pairs fit 63 bits for up to 10^9 words and 4 batches. ``entries``:
    how many a task counts, or adds to a cell, at a time; ``row_entries``: those of one packed row (but a word at least)."""

    words: int
    cells: int
    batches: int
    held: int
    entries: int = 4_000_000
    row_entries: int = 200_000

    @property
    def ranges(self) -> int:
        return -(-self.words // self.held)

    @property
    def each(self) -> int:
        return -(-self.words // self.cells)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the pairs of the words ``a`` with ``b``."""
        place, at_b = a // self.cells, b // self.held
        cell, off = a - place * self.cells, b - at_b * self.held
        word = ((cell * self.batches + (a + b) % self.batches) * self.ranges + at_b) * self.each + place
        return word * self.held + off


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])


def _row(words: np.ndarray, sizes: np.ndarray, partners: np.ndarray, true: np.ndarray, drawn: np.ndarray) -> list[bytes]:
    most = max(int(true.max()), int(drawn.max()))
    times = np.concatenate([true, drawn]).astype(np.min_scalar_type(most))
    return [words.astype(np.int64).tobytes(), sizes.astype(np.int64).tobytes(), partners.astype(np.uint32).tobytes(), times.tobytes()]


def unpacked(row: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, sizes, partners, times): the last has a line for true pairs and one for drawn ones."""
    words, sizes, partners = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.uint32)))
    width = len(row[3]) // (2 * len(partners))
    return words, sizes, partners, np.frombuffer(row[3], f"u{width}").reshape(2, -1)


class Counter:
    """Counts pairs as they come and holds ``entries`` numbers of them."""

    def __init__(self, cells: Cells):
        self.cells, self.held, self.n = cells, np.empty(cells.entries, np.int64), 0

    def add(self, a: np.ndarray, b: np.ndarray, drawn: bool) -> Iterator[pa.RecordBatch]:
        """Rows of ``COUNTED``, if there is no room for the pairs."""
        if self.n + 2 * len(a) > len(self.held):
            yield from self.written()
            self.held = np.empty(max(self.cells.entries, 2 * len(a)), np.int64)
        for x, y in ((a, b), (b, a)):
            self.held[self.n : self.n + len(a)] = self.cells.numbers(x, y) * 2 + drawn
            self.n += len(a)

    def written(self) -> Iterator[pa.RecordBatch]:
        marked, self.n = self.held[: self.n], 0
        if not len(marked):
            return
        marked.sort()
        drawn = (marked & 1).astype(np.int64)
        marked >>= 1
        starts = _starts(marked)
        numbers, drawn = marked[starts], np.add.reduceat(drawn, starts)
        true = np.diff(np.r_[starts, len(marked)]) - drawn
        words, partners = np.divmod(numbers, self.cells.held)
        firsts = _starts(words)
        found = words[firsts] // (self.cells.batches * self.cells.ranges * self.cells.each)
        begins = _starts(found)
        for first, last in zip(begins, np.r_[begins[1:], len(found)]):
            ends = np.r_[firsts[first:last], firsts[last] if last < len(firsts) else len(words)]
            some = slice(ends[0], ends[-1])
            row = _row(words[ends[:-1]], np.diff(ends), partners[some], true[some], drawn[some])
            yield pa.record_batch([pa.array([found[first]]), *(pa.array([x]) for x in row)], names=["cell", *FIELDS])


def _merged(parts: list[Counts]) -> Counts:
    """Counts of equal numbers put together."""
    numbers, true, drawn = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(numbers, kind="stable")
    numbers = numbers[order]
    starts = _starts(numbers)
    return numbers[starts], np.add.reduceat(true[order], starts), np.add.reduceat(drawn[order], starts)


def packed(cells: Cells, cell: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` from all rows of ``COUNTED`` of a cell."""
    parts: list[Counts] = []
    n = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in FIELDS)):
            words, sizes, partners, times = unpacked(row)
            parts.append((np.repeat(words, sizes) * cells.held + partners, *times.astype(np.int64)))
            n += len(partners)
            if n > cells.entries + 2 * len(parts[0][0]):
                parts = [_merged(parts)]
                n = len(parts[0][0])
    numbers, true, drawn = _merged(parts)
    words, partners = np.divmod(numbers, cells.held)
    starts = _starts(words)
    ends = np.r_[starts[1:], len(words)]
    at, place = np.divmod(words[starts], cells.each)
    ids = place * cells.cells + cell
    batch_at, at_b = np.divmod(at - cell * cells.batches * cells.ranges, cells.ranges)
    at_a = ids // cells.held
    groups = _starts((batch_at * cells.ranges + at_b) * cells.ranges + at_a)
    for first, last in zip(groups, np.r_[groups[1:], len(ids)]):
        while first < last:
            upto = max(first + 1, min(last, int(np.searchsorted(ends, starts[first] + cells.row_entries, side="right"))))
            some = slice(starts[first], ends[upto - 1])
            row = _row(ids[first:upto], (ends - starts)[first:upto], partners[some], true[some], drawn[some])
            where = (pa.array([int(x[first])], pa.int32()) for x in (batch_at, at_a, at_b))
            yield pa.record_batch([*(pa.array([x]) for x in row), *where], names=[*FIELDS, "batch", "at_a", "at_b"])
            first = upto
