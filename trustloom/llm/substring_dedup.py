"""Passages that repeat across documents, by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.rows import column, packed, table
from trustloom.llm.words import WHITE_SPACE, mix, small_batches, split_words, window_prints
from trustloom.session import materialise

BATCH_BYTES = 6 << 20
BUCKET_ENTRIES = 1_000_000
PART_BYTES = 8 << 20
# Settled entries that go to one bucket together.
SETTLED_ENTRIES = 1 << 16
LAST = (1 << 63) - 1
# A batch is dealt to so many buckets or parts at a time; more of them take further rounds.
FAN = 1024
# Ids that several rows share: so many are flagged by a broadcast, 8 bytes each. Beyond, all rows are taken for such.
SHARED_IDS = 100_000
CROWDS = 1_000
_ENTRIES = (
    "key int, done boolean, ids binary, salts binary, counts binary, gaps binary, rest binary, prints binary, flags binary")


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte: all lowest bytes first. Numbers in order differ in their low bytes only, so the rest compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Docs:
    """Some documents' words, and which document each word is of."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = split_words(batch.column("text"), WHITE_SPACE)
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        self.salts = batch.column("salt").to_numpy(zero_copy_only=False)
        self.n = np.diff(self.words.first)

    def windows(self, size: int, least: int) -> np.ndarray:
        """The places in all words of the windows of ``size`` words that lie in one document of at least ``least``."""
        count = np.where(self.n >= least, np.maximum(self.n - size + 1, 0), 0)
        ends = np.cumsum(count)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.words.first[:-1] - (ends - count), count)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, places, side="right") - 1

    def rows(
        self, places: np.ndarray, bucket: np.ndarray, width: int, done: bool, prints: list[np.ndarray], flags=None,
    ) -> list[dict]:
        """One packed row per ``width`` buckets for the entries at ``places`` (in order), with fingerprints and flags."""
        doc = self.doc_of(places)
        return _packed(bucket, width, done, self.ids, self.salts, doc, places - self.words.first[doc], prints, flags)


def _packed(
    key: np.ndarray, width: int, done: bool, ids: np.ndarray, salts: np.ndarray, doc: np.ndarray, at: np.ndarray,
    prints: list[np.ndarray], flags: np.ndarray | None = None,
) -> list[dict]:
    """A row for each run of ``width`` keys, with the entries that have them packed: the documents, how many entries each
    has, and the gaps between an entry and the one before it in its document. ``doc`` points into ``ids`` and ``salts``;
    ``rest`` tells the keys of a run apart."""
    first_key, rest = key // width, (key % width).astype(np.uint32)
    order, rows = np.argsort(first_key, kind="stable"), []
    for sel in np.split(order, np.flatnonzero(np.diff(first_key[order])) + 1) if len(order) else []:
        d = doc[sel]
        first = np.flatnonzero(np.r_[True, np.diff(d) != 0])
        gaps = np.diff(at[sel], prepend=0)
        gaps[first] = at[sel][first]
        rows.append({
            "key": int(first_key[sel[0]]), "done": done, "ids": _planes(ids[d[first]].astype(np.int64)),
            "salts": _planes(salts[d[first]].astype(np.int64)),
            "counts": _planes(np.diff(np.r_[first, len(sel)]).astype(np.uint32)), "gaps": _planes(gaps.astype(np.uint32)),
            "rest": rest[sel].tobytes() if width > 1 else b"", "prints": b"".join(p[sel].tobytes() for p in prints),
            "flags": b"" if flags is None else np.packbits(flags[sel]).tobytes()})
    return rows


def widths(keys: int, fan: int) -> list[int]:
    """How many keys stand together in a packed row, by round: each round has at most ``fan`` rows for each it is made of,
    the last one a row per key."""
    found = [1]
    while found[0] * fan < keys:
        found.insert(0, found[0] * fan)
    return found


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = (f.split() for f in _ENTRIES.split(", "))
    return pa.Table.from_pylist(rows, schema=pa.schema([(name, kinds[kind]) for name, kind in fields]))


class _Entries:
    """The entries of a packed row again."""

    def __init__(self, row: dict):
        self.ids, self.salts = _unplaned(row["ids"], "int64"), _unplaned(row["salts"], "int64")
        self.counts = _unplaned(row["counts"], "uint32").astype(np.int64)
        gaps = _unplaned(row["gaps"], "uint32").astype(np.int64)
        sums = np.r_[0, np.cumsum(gaps)]
        starts = np.cumsum(self.counts) - self.counts
        self.at = sums[1:] - np.repeat(sums[starts], self.counts)
        self.key, self.rest, self.prints, self.flags = (row[c] for c in ("key", "rest", "prints", "flags"))


def _all_of(entries: list[_Entries]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, salts, the document of each entry among these, and the places, of all entries."""
    ids, salts = (np.concatenate([getattr(e, c) for e in entries]) for c in ("ids", "salts"))
    doc = np.repeat(np.arange(len(ids)), np.concatenate([e.counts for e in entries]))
    return ids, salts, doc, np.concatenate([e.at for e in entries])


def _prints_of(entries: list[_Entries], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The fingerprints of all entries: one array for each kind of number that they have."""
    found, before = [], 0
    for kind in kinds:
        found.append(np.concatenate(
            [np.frombuffer(e.prints, dtype=kind, count=len(e.at), offset=before * len(e.at)) for e in entries]))
        before += np.dtype(kind).itemsize
    return found


def _flags_of(entries: list[_Entries]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(e.flags, dtype=np.uint8), count=len(e.at)) for e in entries])


def _regrouped(width: int, narrower: int, kinds: tuple[str, ...], flagged: bool, chunk: int):
    """Packed rows of ``width`` keys each, which come sorted, taken together by about ``chunk`` entries and packed again by
    ``narrower`` keys."""

    def packed_again(entries: list[_Entries], done: bool) -> list[dict]:
        if not entries:
            return []
        key = np.concatenate([e.key * width + np.frombuffer(e.rest, dtype=np.uint32).astype(np.int64) for e in entries])
        return _packed(
            key, narrower, done, *_all_of(entries), [] if done else _prints_of(entries, kinds),
            _flags_of(entries) if flagged and not done else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[_Entries]] = {False: [], True: []}
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                entries = _Entries(row)
                held[row["done"]].append(entries)
                n += len(entries.at)
                if n >= chunk:
                    for done, some in held.items():
                        yield from _table(packed_again(some, done)).to_batches()
                    held, n = {False: [], True: []}, 0
        for done, some in held.items():
            yield from _table(packed_again(some, done)).to_batches()

    return run


def part_of(ids, salts, parts: int):
    """The part of the documents that one belongs to. Columns must not be negative: Spark's % keeps the sign, numpy's does
    not."""
    return (ids % parts + salts % parts) % parts


def dealt(n: int, batch: int, buckets: int) -> np.ndarray:
    """Buckets for ``n`` entries that need no judging, piece by piece, by a number that no other batch has: they spread
    evenly whatever documents the batches hold."""
    pieces = np.arange(n, dtype=np.uint64) // np.uint64(SETTLED_ENTRIES)
    return (mix(mix(np.uint64([batch])) + pieces) % np.uint64(buckets)).astype(np.int32)


def _judged(group: pa.Table, judge, parts: int, width: int) -> pa.Table:
    """The entries of a bucket that count, packed by ``width`` parts: those that ``judge`` says, and those that are done
    already."""
    rows = sorted(group.to_pylist(), key=lambda r: r["done"])
    entries = [_Entries(r) for r in rows]
    asked = [e for e, r in zip(entries, rows) if not r["done"]]
    chosen = np.ones(sum(len(e.at) for e in entries), dtype=bool)
    if asked:
        verdict = judge(asked)
        chosen[: len(verdict)] = verdict
    ids, salts, doc, at = _all_of(entries)
    doc, at = doc[chosen], at[chosen]
    return _table(_packed(part_of(ids, salts, parts)[doc], width, False, ids, salts, doc, at, []))


def _places_of(docs: pa.Table, found: pa.Table) -> list[np.ndarray | None]:
    """For each document the places found in it."""
    lists: dict[tuple[int, int], list[np.ndarray]] = {}
    for e in map(_Entries, found.to_pylist()):
        ends = np.cumsum(e.counts).tolist()
        for key, a, b in zip(zip(e.ids.tolist(), e.salts.tolist()), [0, *ends], ends):
            lists.setdefault(key, []).append(e.at[a:b])
    joined = {key: np.concatenate(x) for key, x in lists.items()}
    return [joined.get(key) for key in zip(docs.column("id").to_pylist(), docs.column("salt").to_pylist())]


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    (batch,) = table.combine_chunks().to_batches()  # texts of 2 GB do not fit into one; a part is far below
    return batch


def _groups(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``keys`` (by ``order``): where each run of equal keys starts, and the run of each sorted entry."""
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([np.diff(k[order].view(np.int64 if k.itemsize == 8 else np.int32)) != 0 for k in keys], axis=0)
    return np.flatnonzero(new), np.cumsum(new) - 1


# What an entry's fingerprint is made of.
_ANCHOR, _WINDOW = ("uint32",), ("uint64", "uint32")


def _anchor_entries(window: int, buckets: int, width: int):
    """Every rolling block of half a window of every document, flagged where it is one of the document's fixed blocks."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(small_batches(batches, "text", BATCH_BYTES)):
            docs = _Docs(batch)
            places = docs.windows(block, window)
            print_of = window_prints(docs.words.print, block)[places]
            fixed = (places - docs.words.first[docs.doc_of(places)]) % block == 0
            order = np.argsort(print_of, kind="stable")
            starts, run_of = _groups(order, print_of)
            often = np.diff(np.r_[starts, len(order)]) > 1
            repeated, rep = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
            repeated[order] = often[run_of]
            rep[order[starts]] = True
            if len(order):  # one entry speaks for all with its fingerprint
                flag = np.logical_or.reduceat(fixed[order], starts)
                fixed = fixed.copy()
                fixed[order[starts]] = flag
            bucket = (print_of % np.uint64(buckets)).astype(np.int32)
            high = (print_of >> np.uint64(32)).astype(np.uint32)
            # What repeats within the batch is found here and need not be judged.
            own = dealt(repeated.sum(), task + number, buckets)
            rows = docs.rows(places[rep], bucket[rep], width, False, [high[rep]], fixed[rep])
            yield from _table(rows + docs.rows(places[repeated], own, width, True, [])).to_batches()

    return run


def _judge_anchors(entries: list[_Entries]) -> np.ndarray:
    """A rolling block counts if its fingerprint is there again, one of them a fixed block."""
    (prints,), fixed = _prints_of(entries, _ANCHOR), _flags_of(entries)
    order = np.argsort(prints, kind="stable")
    starts, run_of = _groups(order, prints)
    hit = (np.diff(np.r_[starts, len(order)]) > 1) & (np.maximum.reduceat(fixed[order], starts) > 0)
    chosen = np.zeros(len(order), dtype=bool)
    chosen[order] = hit[run_of]
    return chosen


def _covering(first: int, last: int, starts: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which of the places ``first`` .. ``last`` - 1 lie from ``before`` below a start to ``after`` above it."""
    n = last - first
    steps = np.zeros(n + 1, dtype=np.int64)
    low, high = np.clip(starts - before, 0, n), np.clip(starts + after + 1, 0, n)
    np.add.at(steps, low, 1)
    np.add.at(steps, high, -1)
    return np.cumsum(steps[:n]) > 0


def _window_entries(window: int, buckets: int, width: int):
    """Around each hit every window that holds the block, by two fingerprints of its words. Extending hits this way
    reaches the ends of each repeat exactly: a repeat is a run of windows that are equal elsewhere."""
    block = window // 2

    def run(part: pa.Table, hits: pa.Table) -> pa.Table:
        if not part.num_rows or not hits.num_rows:
            return _table([])
        docs = _Docs(_one_batch(part))
        chosen = np.zeros(len(docs.words.start), dtype=bool)
        for i, at in enumerate(_places_of(part, hits)):
            first, last = docs.words.first[i], docs.words.first[i + 1] - window + 1
            if at is not None and last > first:
                chosen[first:last] = _covering(first, last, at, window - block, 0)
        places = np.flatnonzero(chosen)
        one = window_prints(docs.words.print, window)[places]
        two = (window_prints(docs.words.print, window, 1)[places] >> np.uint64(32)).astype(np.uint32)
        later = _later(one, two, docs.ids[docs.doc_of(places)].astype(np.int64))
        bucket = (one % np.uint64(buckets)).astype(np.int32)
        # A smaller id in the same part settles it.
        own = dealt(later.sum(), part.column("part")[0].as_py(), buckets)
        rows = docs.rows(places[~later], bucket[~later], width, False, [one[~later], two[~later]])
        return _table(rows + docs.rows(places[later], own, width, True, []))

    return run


def _later(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows are also in a document with a smaller id."""
    order = np.lexsort((two, one))
    starts, run_of = _groups(order, one, two)
    later = np.zeros(len(order), dtype=bool)
    if len(order):
        later[order] = ids[order] > np.minimum.reduceat(ids[order], starts)[run_of]
    return later


def _judge_windows(entries: list[_Entries]) -> np.ndarray:
    one, two = _prints_of(entries, _WINDOW)
    return _later(one, two, np.concatenate([np.repeat(e.ids, e.counts) for e in entries]))


def _cleaned(window: int, digest: bool):
    def run(part: pa.Table, marks: pa.Table) -> pa.Table:
        docs = _Docs(_one_batch(part))
        data, n_removed, kept, spans = docs.words.data.tobytes(), [], [], []
        for i, at in enumerate(_places_of(part, marks)):
            first, last = docs.words.first[i], docs.words.first[i + 1]
            gone = np.zeros(last - first, dtype=bool) if at is None else _covering(first, last, at, 0, window - 1)
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            spans.append([{"start": int(a), "size": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
            stay = first + np.flatnonzero(~gone)
            text = b" ".join([data[a:b] for a, b in zip(docs.words.start[stay].tolist(), docs.words.end[stay].tolist())])
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            n_removed.append(int(gone.sum()))
        span = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))
        return pa.table({
            "id": part.column("id"), "copies": part.column("copies"), "n_words": pa.array(docs.n, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, span)})

    return run


def _identified(source: DataFrame, rows: int, shared_ids: int) -> DataFrame:
    """``source`` (id, text), of ``rows`` rows, with ``salt``, which tells rows of one id apart and spreads ids
    over the parts, and ``copies``: 31 bits of the id for rows whose id is theirs alone, else 64 bits of the text; so rows
    of one id and salt have the same text. Where many rows share an id, more than
    one in ``CROWDS``, those of one text become a row that says how many ``copies`` there are."""
    own, texts, one = F.hash("id").bitwiseAND(F.lit((1 << 31) - 1)).cast("long"), F.xxhash64("text"), F.lit(1).cast("long")
    alone = source.select("id", "text", own.alias("salt"), one.alias("copies"))
    shared = materialise(source.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1), "shared-ids")
    n = shared.count()
    if not n:
        return alone
    if n > shared_ids:
        flagged = source.withColumn("met", F.lit(True))
    else:
        flagged = source.join(F.broadcast(shared.select("id", F.lit(True).alias("met"))), "id", "left")
    flagged = flagged.select(
        "id", "text", F.when(F.col("met"), texts).otherwise(own).alias("salt"), one.alias("copies"))
    crowds = shared.where(F.col("n") * CROWDS > rows).select("id")  # fewer than that, so they are broadcast
    if crowds.isEmpty():
        return flagged
    crowded = flagged.join(F.broadcast(crowds), "id", "left_semi").groupBy("id", "salt").agg(
        F.first("text").alias("text"), F.sum("copies").alias("copies"))
    return flagged.join(F.broadcast(crowds), "id", "left_anti").unionByName(crowded)


def remove_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = 50, digest: bool = False,
    bucket_entries: int = BUCKET_ENTRIES, part_bytes: int = PART_BYTES, fan: int = FAN, shared_ids: int = SHARED_IDS,
) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space; with
    ``digest`` its SHA-256) and ``spans`` (start and size, in words, of each run removed).

    A word goes if it lies in ``window`` consecutive words that also stand in a document with a smaller id; the smallest
    id keeps them. Windows are judged on the input. Words are separated by ASCII white space and compared unchanged.

    1. Each document is cut into fixed blocks of half a window, so every window holds a whole one. The blocks are the
       index, every rolling block is a probe, and both meet by fingerprint (32 bits and the bucket's own; a chance hit
       costs time, not results).
    2. Every window that holds a hit is compared by 96 bits of its words' fingerprints, which extends each hit to the
       ends of its repeat. Only these windows are moved.
    3. Places of repeated windows go back to their documents.

    Entries travel packed, a row per bucket and batch of documents, about six bytes each. Before that, every batch
    settles what repeats within it, so that a passage which a third of all documents share meets once per batch in its
    bucket. What is settled is dealt to all buckets in pieces. Buckets hold about ``bucket_entries`` entries, and parts of
    the documents about ``part_bytes`` of text, however large the input is. Where there are more than ``fan`` of them,
    entries get there in rounds, by ``fan`` ways each, and are packed anew in between: so there are at most ``fan`` rows for
    each batch and round. Texts are shuffled once, to parts; the hits and the repeated windows of a part join them there.

    Null and empty texts have no words. A null id comes after all others, and equal ids are not smaller than each other:
    rows repeated whole keep their passages unless a smaller id has them; each row comes back. Documents shorter than a
    window lose nothing.
    """
    source = packed(docs).select(
        F.coalesce(column(id, "row").cast("long"), F.lit(LAST)).alias("id"),
        F.coalesce(column(text, "row"), F.lit("")).alias("text"))
    size, n = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-size // (6 * bucket_entries)))
    parts = max(1, -(-size // part_bytes))
    by_bucket, by_parts = widths(buckets, fan), widths(parts, fan)
    source = _identified(source, n, shared_ids)
    id_part, salt_part = (F.pmod(F.col(c), F.lit(parts)) for c in ("id", "salt"))
    part = part_of(id_part, salt_part, parts).cast("int")
    by_part = source.select(part.alias("part"), "id", "salt", "copies", "text").groupBy("part")

    def dealt_on(rows: DataFrame, steps: list[int], kinds: tuple[str, ...], flagged: bool) -> DataFrame:
        """Packed rows of ``steps[0]`` keys each as rows of a single key, round by round."""
        for width, narrower in zip(steps, steps[1:]):
            rows = rows.repartition("key").sortWithinPartitions("key").mapInArrow(
                _regrouped(width, narrower, kinds, flagged, bucket_entries), _ENTRIES)
        return rows

    def met(entries: DataFrame, judge, kinds: tuple[str, ...], flagged: bool) -> DataFrame:
        entries = dealt_on(entries, by_bucket, kinds, flagged)
        judged = entries.groupBy("key").applyInArrow(lambda group: _judged(group, judge, parts, by_parts[0]), _ENTRIES)
        return dealt_on(judged, by_parts, (), False).groupBy("key")

    hits = met(source.mapInArrow(_anchor_entries(window, buckets, by_bucket[0]), _ENTRIES), _judge_anchors, _ANCHOR, True)
    around = by_part.cogroup(hits).applyInArrow(_window_entries(window, buckets, by_bucket[0]), _ENTRIES)
    result = by_part.cogroup(met(around, _judge_windows, _WINDOW, False)).applyInArrow(
        _cleaned(window, digest),
        "id bigint, copies bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:int,size:int>>")
    given = F.when(F.col("id") != LAST, F.col("id")).alias(id)
    # In two steps, so that no array grows with the number of copies.
    result = result.withColumn("_tens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))
    left = F.least(F.col("copies") - F.col("_tens") * 1000, F.lit(1000))
    result = result.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return result.select(given, "n_words", "n_removed", "kept", "spans")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}

ORACLES = {
    "op9_substring_dedup": r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS ws FROM documents),
windows AS (
    SELECT doc_id, s, sha256(array_to_string(ws[s : s + 49], ' ')) AS win
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM cut WHERE len(ws) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p
    FROM windows JOIN firsts USING (win) WHERE doc_id > first_id),
gone_lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
    SELECT doc_id, p, ws[p] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM cut WHERE len(ws) > 0)
    ANTI JOIN gone USING (doc_id, p)),
texts AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM cut LEFT JOIN gone_lists USING (doc_id) LEFT JOIN texts USING (doc_id)"""
}
