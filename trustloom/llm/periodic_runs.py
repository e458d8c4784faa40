"""Runs of words that repeat with a period, by online dyadic square catching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.bpe import _with_columns
from trustloom.llm.rows import let, table
from trustloom.llm.words import WHITE_SPACE, Words, _Powers, mix, split_words

APPENDED = 1 << 16  # words appended at a time
_POWERS = _Powers(0xC2B2AE3D27D4EB4F)
_SPACE = 0x20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _joined(spans: np.ndarray, size: int) -> np.ndarray:
    """Rows (period, lo, hi) with those of one period that touch or overlap made one, sorted. ``size``: above any hi."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    base = spans[:, 0] * (size + 1)
    top = np.maximum.accumulate(base + spans[:, 2])
    first = np.ones(len(spans), dtype=bool)
    first[1:] = (base + spans[:, 1])[1:] > top[:-1]
    at = np.flatnonzero(first)
    out = spans[at]
    if len(at):
        out[:, 2] = top[np.r_[at[1:] - 1, len(spans) - 1]] - base[at]
    return out


class SquareCatchers:
    """Finds the squares of a sequence while it grows: stretches of 2q words whose halves are equal.

    Level L = 1, 2, 4, .. is in charge of the periods from 2L-1 to 4L-2. It has a catcher for each completed block of L
    words, beginning at the multiples of L: the first half of any such square holds a whole block, and the block stands
    again q words later. So a catcher waits while the next 2L-1 to 4L-2 words are appended; whenever the suffix of L words
    equals its block, the comparison is carried on to both sides, to the right as far as words have come, and taken up
    again with the words appended next. A stretch where q or more words equal those q later is a square; squares of one
    period that overlap are one run.

    Blocks and suffixes are compared by rolling fingerprints, those of all words appended together in one go. A block
    that stands in a run of period at most L, as does its copy, can only give multiples of that period and is passed by.
    So there are at most two comparisons for each word and level.
    """

    def __init__(self, size: int):
        self.n = 0
        self.codes = np.zeros(size, dtype=np.uint64)
        self.sums = np.zeros(size + 1, dtype=np.uint64)
        #: By level: the runs so far, and the comparisons that end where the words end, as rows (period, lo, hi): the
        #: words from lo to hi equal those one period later. ``limit``: how far a comparison goes at most.
        self.runs: list[np.ndarray] = []
        self.open: list[tuple[np.ndarray, np.ndarray]] = []

    def _prints(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def _agree(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """For how many words, at most ``limit``, the texts from (or, ``back``, up to) places x and y agree."""
        same = np.zeros(len(x), dtype=np.int64)
        step = 1 << (int(limit.max(initial=0)).bit_length() - 1) if limit.max(initial=0) > 0 else 0
        while step:
            more = same + step
            i = np.flatnonzero(more <= limit)
            from_x, from_y = (x[i] - more[i], y[i] - more[i]) if back else (x[i], y[i])
            equal = self._prints(from_x, more[i]) == self._prints(from_y, more[i])
            same[i[equal]] = more[i[equal]]
            step >>= 1
        return same

    def append(self, codes: np.ndarray, longest: int) -> None:
        """Appends words; squares of periods up to ``longest`` that reach into them are caught."""
        old, new = self.n, self.n + len(codes)
        up, self.down = _POWERS(new + 1)
        self.n = new
        self.codes[old:new] = codes
        self.sums[old + 1 : new + 1] = self.sums[old] + np.cumsum(mix(codes) * up[old:new])
        known = [np.zeros((0, 3), dtype=np.int64)]
        level, block = 0, 1
        while level < len(self.runs) or 2 * block - 1 <= longest:
            if level == len(self.runs):
                self.runs.append(known[0])
                self.open.append((known[0], np.zeros(0, dtype=np.int64)))
            found, limit = self.open[level]
            if 2 * block - 1 <= longest:
                hits, hit_limit = self._hits(block, old, new, longest, np.concatenate(known))
                found, limit = np.concatenate([found, hits]), np.concatenate([limit, hit_limit])
            to = found[:, 2]
            to += self._agree(to, to + found[:, 0], np.minimum(limit, new - found[:, 0]) - to, back=False)
            square = found[to - found[:, 1] >= found[:, 0]]
            self.runs[level] = _joined(np.concatenate([self.runs[level], square]), new)
            goes_on = (to < limit) & (to + found[:, 0] == new)
            self.open[level] = found[goes_on], limit[goes_on]
            known.append(self.runs[level])
            level, block = level + 1, 2 * block

    def _hits(self, block: int, old: int, new: int, longest: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a suffix of the words equals the block of a catcher, carried on to the left."""
        first, last = max(old - block + 1, 2 * block - 1), new - block
        if last < first:
            return np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.arange(first, last + 1)
        suffix = self._prints(at, block)
        near = (at - (2 * block - 1)) // block  # the nearer of the two blocks in charge, by its number
        low = max(int(near[0]) - 1, 0)
        blocks = self._prints(np.arange(low, int(near[-1]) + 1) * block, block)
        starts, places = [], []
        for number in (near, near - 1):
            equal = np.flatnonzero((number >= 0) & (blocks[np.maximum(number - low, 0)] == suffix))
            starts.append(number[equal] * block)
            places.append(at[equal])
        start, place = np.concatenate(starts), np.concatenate(places)
        period = place - start
        known = known[known[:, 0] <= block]
        known = known[np.argsort(known[:, 1], kind="stable")]
        reach = np.r_[-1, np.maximum.accumulate(known[:, 2] + known[:, 0])] if len(known) else np.array([-1])
        inside = reach[np.searchsorted(known[:, 1], start, side="right")] >= place + block
        go = ~inside & (period <= longest)
        start, place, period = start[go], place[go], period[go]
        back = self._agree(start, place, np.minimum(period - block, start), back=True)
        return np.stack([period, start - back, start + block], axis=1), start + period

    def found(self) -> np.ndarray:
        """All runs (period, lo, hi) of at least two periods, lo and hi as the words from the first to the last, each with
        its smallest period."""
        every = np.concatenate(self.runs) if self.runs else np.zeros((0, 3), dtype=np.int64)
        every = np.stack([every[:, 0], every[:, 1], every[:, 2] + every[:, 0]], axis=1)
        every = every[np.lexsort((every[:, 0], every[:, 2], every[:, 1]))]
        # A run seen with a multiple of its period is the very same stretch.
        first = np.ones(len(every), dtype=bool)
        first[1:] = (every[1:, 1:] != every[:-1, 1:]).any(axis=1)
        return every[first]


def _plain_runs(codes: np.ndarray) -> np.ndarray:
    """The same by comparing the words themselves for every period."""
    found = []
    for q in range(1, len(codes) // 2 + 1):
        edge = np.diff(np.r_[False, codes[q:] == codes[:-q], False].astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = hi - lo >= q
        found.append(np.stack([np.full(keep.sum(), q), lo[keep], hi[keep] + q], axis=1))
    every = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    every = every[np.lexsort((every[:, 0], every[:, 2], every[:, 1]))]
    _, first = np.unique(every[:, 1:], axis=0, return_index=True)
    return every[np.sort(first)]


def _true_runs(runs: np.ndarray, codes: np.ndarray) -> bool:
    return all(np.array_equal(codes[lo : hi - q], codes[lo + q : hi]) for q, lo, hi in runs)


def runs_of(codes: np.ndarray, first: np.ndarray, min_exponent: int) -> np.ndarray:
    """The runs (period, lo, hi) of at least ``min_exponent`` periods in some texts of words: ``first`` tells where each
    begins in ``codes`` (one more entry than texts).

    The texts go one after the other, the longest first and a word of its own between two, into the same catchers: so no
    square reaches over an end, and the longer periods are looked for only where a text is long enough for them.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= min_exponent]
    sizes = sizes[order]
    begin = np.r_[0, np.cumsum(sizes + 1)]
    stream = np.empty(begin[-1], dtype=np.uint64)
    inside = np.ones(begin[-1], dtype=bool)
    inside[begin[1:] - 1] = False
    shift = first[order] - begin[:-1]
    places = np.repeat(shift, sizes + 1) + np.arange(begin[-1])
    stream[inside] = codes[places[inside]]
    stream[~inside] = mix(np.arange(len(order), dtype=np.uint64) + np.uint64(1 << 63))
    catchers = SquareCatchers(len(stream))
    for at in range(0, len(stream), APPENDED):
        longest = int(sizes[np.searchsorted(begin, at, side="right") - 1]) // min_exponent
        catchers.append(stream[at : at + APPENDED], longest)
    runs = catchers.found()
    if not _true_runs(runs, stream):  # two different stretches share a fingerprint
        parts = [_plain_runs(stream[a : b - 1]) + [[0, a, a]] for a, b in zip(begin[:-1], begin[1:])]
        runs = np.concatenate(parts)
    runs = runs[runs[:, 2] - runs[:, 1] >= min_exponent * runs[:, 0]]
    runs[:, 1:] += shift[np.searchsorted(begin, runs[:, 1], side="right") - 1][:, None] if len(runs) else 0
    return runs[np.lexsort((runs[:, 0], runs[:, 1]))]


def kept_text(words: Words, keep: np.ndarray) -> pa.Array:
    """Of each text the words to keep, joined by one space."""
    text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[keep]
    start, end = words.start[keep], words.end[keep]
    followed = np.zeros(len(start), dtype=bool)
    followed[:-1] = text_of[1:] == text_of[:-1]
    change = np.zeros(len(words.data) + 2, dtype=np.int8)
    change[start] += 1
    np.subtract.at(change, end + followed, 1)
    stays = np.cumsum(change[: len(words.data)], dtype=np.int8).astype(bool)
    data = words.data.copy()
    data[end[followed]] = _SPACE
    length = np.bincount(text_of, weights=end - start + followed, minlength=len(words.first) - 1).astype(np.int64)
    offsets = np.r_[0, np.cumsum(length)]
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[stays])]).cast(pa.string())


def periodic_runs(docs: DataFrame, *, text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period) and ``collapsed``; they replace columns of those names.
    Rows are neither added nor lost, and every row keeps its other columns, whatever their names.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words that repeats with its
    smallest period, has at least ``min_length`` words and ``min_exponent`` periods (2 or more) and could not be longer to
    either side; runs are listed by start, then period, and may overlap. ``collapsed`` is the text without the words that
    lie in a run after its first period, the others joined by one space. Null and empty texts have no runs and are empty
    when collapsed. Texts of any length are judged whole, in n log² n steps, within the task that reads them: nothing is
    shuffled, so rows repeated any number of times, ties and null ids play no part.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        words = split_words(batch.column("text"), WHITE_SPACE)
        runs = runs_of(words.print, words.first, min_exponent)
        runs = runs[runs[:, 2] - runs[:, 1] >= min_length]
        period, lo, hi = runs[:, 0], runs[:, 1], runs[:, 2]
        change = np.zeros(len(words.start) + 1, dtype=np.int64)
        np.add.at(change, lo + period, 1)
        np.subtract.at(change, hi, 1)
        of = np.searchsorted(words.first, lo, side="right") - 1
        offsets = np.searchsorted(of, np.arange(len(words.first))).astype(np.int32)
        flat = pa.StructArray.from_arrays(
            [pa.array(x) for x in (lo - words.first[of], hi - lo, period)], fields=list(_RUN))
        return [pa.ListArray.from_arrays(pa.array(offsets), flat), kept_text(words, np.cumsum(change[:-1]) == 0)]

    return _with_columns(docs, text, run, [("runs", RUNS), ("collapsed", "string")])


def with_planted_runs(id: Column, text: Column) -> Column:
    """The text, and for one document in ten (by a checksum of its id) a text that repeats itself from some word on."""
    check = F.crc32(id.cast("string"))
    g = F.floor(check / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        word = lambda i: F.element_at(words, (i + 1).cast("int"))
        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: word(F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])))), " ")).otherwise(text)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(check % 10 == 0, let(words, repeat)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs(docs).withColumn("best", best)
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
