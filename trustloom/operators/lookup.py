"""Attach a word table to word occurrences without moving the frequent words.

Tables here are fitted ones: written, so that counting them reads file footers only. A table of at most ``hot_rows``
rows is broadcast. A larger one is cut in two: word frequencies are skewed, and its most frequent words, as many as
``hot_rows`` and ``hot_bytes`` allow, make up nearly all occurrences. That head is broadcast; only occurrences it does not cover are shuffled to meet the tail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from trustloom.session import materialise

HOT_ROWS = 200_000
HOT_BYTES = 32 << 20
# Rows of a table that are hashed in one partition of a shuffle at most.
HASHED_ROWS = 500_000
# List entries that a task works on at a time.
ENTRIES = 500_000
# Steps of a histogram of counts per doubling, and parts by digest of the step that is cut.
STEPS, DIGESTS = 32, 4096

Parts = tuple[DataFrame, DataFrame | None]
_MISSED = ArrayType(StructType().add("pos", IntegerType()).add("w", StringType()))


def _taken(sizes: list, rows: int, size: int) -> tuple[int, int, int]:
    """How many of ``sizes`` (.., rows, bytes) fit one after the other, and what room is left then."""
    for i, entry in enumerate(sizes):
        if entry["n"] > rows or entry["bytes"] > size:
            return i, rows, size
        rows, size = rows - entry["n"], size - entry["bytes"]
    return len(sizes), rows, size


def by_count(
    table: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES
) -> Parts:
    """(head, tail) of a word table by a count column: the most frequent words, at most ``hot_rows`` and ``hot_bytes`` of
    them; no tail if the head holds all.

    Nothing is sorted: a histogram of the counts on a logarithmic scale tells the step at which the room ends, and of
    that step's words those with the first digests are taken. Both parts are filters on the table, which is read by
    column and combined in the tasks, to a few thousand numbers.
    """
    step = F.floor(F.log2(F.greatest(F.col(count).cast("double"), F.lit(2.0**-60))) * STEPS)
    digest = F.pmod(F.xxhash64(key), F.lit(DIGESTS))
    widths = F.octet_length(F.col(key).cast("string")) + 8 * len(table.columns)
    sums = [F.count("*").alias("n"), F.sum(widths).alias("bytes")]
    steps = table.groupBy(step.alias("at")).agg(*sums).orderBy(F.desc("at")).collect()
    taken, rows, size = _taken(steps, hot_rows, hot_bytes)
    if taken == len(steps):
        return table, None
    cut = steps[taken]["at"]
    parts = table.where(step == cut).groupBy(digest.alias("at")).agg(*sums).orderBy("at").collect()
    full, _, _ = _taken(parts, rows, size)
    first_left = parts[full]["at"]
    return (
        table.where((step > cut) | ((step == cut) & (digest < first_left))),
        table.where((step < cut) | ((step == cut) & (digest >= first_left))))


def by_rank(
    table: DataFrame, key: str, rank: str, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES
) -> Parts:
    """(head, tail) of a word table whose rank starts at 1 with the most frequent word."""
    head, tail = by_count(table.withColumn("_order", F.lit(1.0) / F.col(rank)), key, "_order", hot_rows, hot_bytes)
    return head.drop("_order"), None if tail is None else tail.drop("_order")


def meet_head(left: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """Left join with the broadcast head. ``_missed`` is the word where the head had none."""
    met = left.join(F.broadcast(head.withColumn("_met", F.lit(True))), key, "left")
    return met.withColumn("_missed", F.when(F.col("_met").isNull(), F.col(key))).drop("_met")


def meet_tail(met: DataFrame, tail: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of the missed words with the tail. Rows already served probe with a non-word made of ``spread``, so
    that they neither match nor pile up in the partition of null keys."""
    probe = F.coalesce(F.col("_missed"), F.concat(F.lit("#"), spread.cast("string")))
    return met.withColumn("_probe", probe).join(tail.withColumnRenamed(key, "_probe"), "_probe", "left").drop("_probe")


def bounded(table: DataFrame, rows: int, max_rows: int = HOT_ROWS) -> DataFrame:
    """``table``, known to have ``rows`` rows, marked for broadcast if these are at most ``max_rows``. A larger one is
    joined by shuffle, where adaptive execution splits heavy keys; it is hashed and the other side not sorted, unless its
    rows are too many for that."""
    if rows <= max_rows:
        return F.broadcast(table)
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.hint("shuffle_hash") if rows <= HASHED_ROWS * partitions else table


def fits(table: DataFrame, *columns: str, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> bool:
    """Whether a written table is small enough to be held by every task, in rows and in bytes."""
    size = sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(0))
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found.n <= hot_rows and found.bytes <= hot_bytes


def one_each(table: DataFrame, key: str, value: str) -> DataFrame:
    """The table with one entry a word, the smallest."""
    return table.groupBy(key).agg(F.min(value).alias(value))


def pieces(batch: pa.RecordBatch, column: int, entries: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``entries`` (``ENTRIES``) list entries in a column, but a row at least: what a task
    needs beside the batch does not grow with its lists."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        after = max(at + 1, int(np.searchsorted(ends, before + (entries or ENTRIES), side="right")))
        yield batch.slice(at, after - at)
        at = after


def _lists(values: pa.Array, lists: pa.Array) -> pa.ListArray:
    """``values`` in lists as long as ``lists``; no list is an empty one."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values)


def replaced(
    docs: DataFrame, table: DataFrame, ids: list[str], words: str, *, key: str, value: str, name: str,
    default: int | str | None = None, missed: str | None = None,
) -> DataFrame:
    """(ids.., name): each word of the list ``words`` replaced in place by its ``value``. Words that ``table`` lacks become
    ``default``, or stay if there is none. Of several entries of a word the smallest counts. No list is an empty one.
    Nothing is shuffled; ``table`` must be one that ``fits``. With ``missed`` a column of that name lists the words that
    the table lacks, with their places."""
    entries = table.select(key, value).toArrow().sort_by([(key, "ascending"), (value, "ascending")]).combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = (shared.value.column(c).combine_chunks() for c in (key, value))
        for batch in (piece for whole in batches for piece in pieces(whole, len(ids))):
            lists = batch.column(len(ids))
            flat = lists.flatten()
            at = pc.index_in(flat, value_set=keys)
            met = values.take(at)
            met = pc.coalesce(met, flat) if default is None else pc.fill_null(met, default)
            columns = [*batch.columns[: len(ids)], _lists(met, lists)]
            if missed:
                absent = np.flatnonzero(pc.and_(pc.is_null(at), pc.is_valid(flat)).to_numpy(zero_copy_only=False))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
                begin = np.r_[0, ends]
                doc = np.searchsorted(ends, absent, side="right")
                rows = pa.StructArray.from_arrays(
                    [pa.array((absent - begin[doc]).astype(np.int32)), flat.take(pa.array(absent))], names=["pos", "w"])
                offsets = np.searchsorted(absent, begin).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), rows))
            yield pa.record_batch(columns, names=[*ids, name, *([missed] if missed else [])])

    schema = StructType([*docs.select(*ids).schema]).add(name, ArrayType(table.schema[value].dataType))
    if missed:
        schema = schema.add(missed, _MISSED)
    return docs.select(*ids, words).mapInArrow(run, schema)


def replaced_by_parts(
    docs: DataFrame, parts: Parts, ids: list[str], words: str, *, key: str, value: str, name: str,
    default: int | str | None = None,
) -> DataFrame:
    """As ``replaced`` for a table of any size, cut in two. Words of the head are replaced where they stand. Only the words
    it lacks are shuffled, with their places, to meet the tail, and only documents that have a word of the tail are joined
    with what was found; the others never move."""
    head, tail = parts
    if tail is None:
        return replaced(docs, head, ids, words, key=key, value=value, name=name, default=default)
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    first = materialise(
        replaced(rows, head, ["_row", *ids], words, key=key, value=value, name=name, default=default, missed="_missed"),
        "replaced")
    asked = first.where(F.size("_missed") > 0).select("_row", F.inline("_missed"))
    found = asked.join(one_each(tail, key, value).withColumnRenamed(key, "w"), "w").groupBy("_row").agg(
        F.collect_list("pos").alias("_at"), F.collect_list(value).alias("_values"))
    kind = first.schema[name].dataType

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, at, values = (batch.column(c) for c in (name, "_at", "_values"))
            flat, at_flat = lists.flatten(), at.flatten().to_numpy(zero_copy_only=False)
            begin = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            n = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
            take = np.arange(len(flat))
            take[at_flat + np.repeat(begin[:-1], n)] = len(flat) + np.arange(len(at_flat))
            both = pa.concat_arrays([flat, values.flatten()]).take(pa.array(take))
            yield pa.record_batch([*(batch.column(c) for c in ids), _lists(both, lists)], names=[*ids, name])

    schema = StructType([*first.select(*ids).schema]).add(name, kind)
    late = first.where(F.size("_missed") > 0).drop("_missed").join(found, "_row", "left").drop("_row")
    return first.where(F.size("_missed") == 0).select(*ids, name).unionByName(late.mapInArrow(fill, schema))
