"""Time-decayed trust per key: an ordered fold that keeps its shape when one key holds most of the events.

Every event maps the trust x of its key to a*x + b, where a holds the decay since the key's previous event. Such steps
compose, so a slice of a key's timeline boils down to one pair (A, B). Keys of ordinary size are folded whole inside one
partition. A key above ``slice_rows`` is cut by (ts, seq) ranges over many partitions; the slices are folded side by
side, and a second, tiny fold over one row per slice gives the trust each slice starts from.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.functions.constants import START_TRUST
from trustloom.functions.scalar import clamp, micros, round_half_even
from trustloom.session import materialise

MICROS = {"hour": 3_600_000_000, "day": 86_400_000_000}
BROADCAST_KEYS = 500_000

# What becomes of an event: folded, not after the state of its key, or a repetition of the one before.
FOLDED, LATE, AGAIN = 0, 1, 2

_PREFIX_FIELDS = [
    T.StructField("_skip", T.IntegerType()),
    T.StructField("_a", T.DoubleType()),
    T.StructField("_b", T.DoubleType()),
    T.StructField("_first_us", T.LongType()),
    T.StructField("_gap_us", T.LongType()),
]


def _run_starts(keys: pa.Array, carried_key: object, has_carry: bool) -> np.ndarray:
    """Where a new key begins in a batch sorted by key."""
    starts = np.empty(len(keys), dtype=bool)
    starts[0] = not (has_carry and keys[0].as_py() == carried_key)
    if len(keys) > 1:
        both_null = pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1]))
        same = pc.or_(pc.fill_null(pc.equal(keys[1:], keys[:-1]), False), both_null)
        starts[1:] = ~same.to_numpy(zero_copy_only=False)
    return starts


def _compose_prefix(a: np.ndarray, b: np.ndarray, run_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of all steps of the run up to each row, by doubling the span. All factors are within [0, 1], so
    nothing overflows and nothing is ever divided by a vanished product."""
    span, longest = 1, int(run_row.max()) + 1
    while span < longest:
        reach = run_row[span:] >= span
        left_a, left_b = a[:-span], b[:-span]
        b = np.concatenate([b[:span], np.where(reach, a[span:] * left_b + b[span:], b[span:])])
        a = np.concatenate([a[:span], np.where(reach, a[span:] * left_a, a[span:])])
        span *= 2
    return a, b


def _no_later(seq: pa.Array, than: pa.Array) -> np.ndarray:
    """Whether each of ``seq`` is at most its entry of ``than``; nulls come first."""
    below = pc.if_else(pc.is_null(than), False, pc.less_equal(seq, than))
    return pc.if_else(pc.is_null(seq), True, below).to_numpy(zero_copy_only=False).astype(bool)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both_null).to_numpy(zero_copy_only=False)


def _fold_batches(key: str, seq_col: str, rate_us: float, reward: float, keep: float, strict: bool):
    """Arrow batches sorted by key, state first, then (us, seq) -> the same rows with (A, B), the key's first time and the
    gap. A row with ``_set`` is the state of its key: it maps whatever was before to that trust at its time. With
    ``strict``, events not after the state, and repetitions of the event before, change nothing and are marked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys, seq = batch.column(key), batch.column(seq_col)
            us = batch.column("_us").to_numpy(zero_copy_only=False)
            good = batch.column("_good").to_numpy(zero_copy_only=False)
            value = batch.column("_set").to_numpy(zero_copy_only=False).astype(float)
            state = ~np.isnan(value)
            starts = _run_starts(keys, carry["key"] if carry else None, carry is not None)
            row = np.arange(n)
            run_first = np.maximum.accumulate(np.where(starts, row, -1))
            continued = run_first < 0
            head = np.maximum(run_first, 0)

            skip = np.zeros(n, dtype=np.int32)
            if strict:
                at, has, last = us[head], state[head], seq.take(pa.array(head))
                shifted = pa.concat_arrays([carry["seq"] if carry else pa.nulls(1, seq.type), seq[: n - 1]])
                earlier = np.concatenate([[carry["raw"] if carry else 0], us[:-1]])
                from_state = np.concatenate([[carry["state"] if carry else False], state[:-1]])
                if carry:
                    at, has = np.where(continued, carry["at"], at), np.where(continued, carry["has"], has)
                    last = pc.if_else(pa.array(continued), carry["last"][0], last)
                again = ~starts & ~state & ~from_state & (us == earlier) & _same(seq, shifted)
                late = has & ~state & ((us < at) | ((us == at) & _no_later(seq, last)))
                skip = np.where(late, LATE, np.where(again, AGAIN, FOLDED)).astype(np.int32)
                carried = {"at": at[-1], "has": has[-1], "last": last[n - 1 :], "seq": seq[n - 1 :], "raw": us[-1], "state": state[-1]}
                us = np.where(late, at, us)  # a late event takes no time
            before = np.concatenate([[carry["us"] if carry else us[0]], us[:-1]])
            gap = np.where(starts, 0, us - before)
            a = np.where(good, 1.0 - reward, keep) * np.exp(-rate_us * gap)
            b = np.where(good, 100.0 * reward, 0.0)
            a, b = np.where(skip > 0, 1.0, np.where(state, 0.0, a)), np.where(skip > 0, 0.0, np.where(state, value, b))
            a, b = _compose_prefix(a, b, row - head)
            first = us[head]
            if carry:
                b = np.where(continued, a * carry["b"] + b, b)
                a = np.where(continued, a * carry["a"], a)
                first = np.where(continued, carry["first"], first)
            carry = {"key": keys[n - 1].as_py(), "us": us[-1], "a": a[-1], "b": b[-1], "first": first[-1]}
            if strict:
                carry |= carried
            added = [pa.array(skip), pa.array(a), pa.array(b), pa.array(first), pa.array(gap, mask=starts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, *(f.name for f in _PREFIX_FIELDS)]
            )

    return run


def _compose_batches(key: str):
    """Arrow batches of steps (_a, _b) sorted by key and slice -> the composed steps in their place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(key)
            starts = _run_starts(keys, carry[0] if carry else None, carry is not None)
            row = np.arange(n)
            run_first = np.maximum.accumulate(np.where(starts, row, -1))
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b"))
            a, b = _compose_prefix(a, b, row - np.maximum(run_first, 0))
            if carry:
                continued = run_first < 0
                b = np.where(continued, a * carry[2] + b, b)
                a = np.where(continued, a * carry[1], a)
            carry = (keys[n - 1].as_py(), a[-1], b[-1])
            columns = dict(zip(batch.schema.names, batch.columns)) | {"_a": pa.array(a), "_b": pa.array(b)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _with_prefix(
    df: DataFrame, key: str, seq: str, rate_us: float, reward: float, keep: float, strict: bool
) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *_PREFIX_FIELDS])
    return df.mapInArrow(_fold_batches(key, seq, rate_us, reward, keep, strict), schema)


def on_key(left: DataFrame, right: DataFrame, key: str, how: str, *more: str) -> DataFrame:
    """Join on ``key``, where a null is a key like any other, and on the columns ``more``."""
    right = right.withColumnsRenamed({key: "_right_key"} | {m: f"_right_{m}" for m in more})
    same = F.col(key).eqNullSafe(F.col("_right_key"))
    for m in more:
        same &= F.col(m) == F.col(f"_right_{m}")
    return left.join(right, same, how).drop("_right_key", *(f"_right_{m}" for m in more))


def _entry(x0: Column, t0: Column, first_us: Column, rate_us: float, start: float) -> Column:
    """Trust on arrival at the first event of a run: decayed from (x0, t0), or the start value for a new key."""
    return F.when(x0.isNull(), F.lit(start)).otherwise(x0 * F.exp(-rate_us * (first_us - t0)))


def _slice_entries(sliced: DataFrame, key: str, seq: str, rate_us: float, start: float) -> DataFrame:
    """(key, slice, _x0, _t0): the trust and time at the end of the previous slice. One row per slice."""
    last = F.struct(F.col("_set").isNull(), "_us", seq)
    ends = sliced.groupBy(key, "_slice").agg(
        F.max_by("_a", last).alias("_a"),
        F.max_by("_b", last).alias("_b"),
        F.min("_first_us").alias("_first_us"),
        F.max("_us").alias("_last_us"),
    )
    timeline = Window.partitionBy(key).orderBy("_slice")
    previous_end = F.lag("_last_us").over(timeline)
    ends = ends.withColumn("_prev_us", previous_end).withColumn(
        "_a", F.when(F.col("_prev_us").isNull(), F.col("_a")).otherwise(
            F.col("_a") * F.exp(-rate_us * (F.col("_first_us") - F.col("_prev_us")))
        ),
    )
    composed = (
        ends.repartition(F.col(key)).sortWithinPartitions(key, "_slice").mapInArrow(_compose_batches(key), ends.schema)
    )
    left_with = F.lag(F.col("_a") * F.lit(start) + F.col("_b")).over(timeline)
    return composed.select(key, "_slice", left_with.alias("_x0"), F.col("_prev_us").alias("_t0"))


def _shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def trust_fold(
    events: DataFrame,
    *,
    key: str,
    ts: str,
    seq: str,
    good: Column,
    unit: str = "hour",
    rate: float = 0.1,
    reward: float = 0.1,
    keep: float = 0.5,
    start: float = START_TRUST,
    state: DataFrame | None = None,
    strict: bool = False,
    slice_rows: int = 1_000_000,
    now: Column | None = None,
) -> DataFrame:
    """Trust after every event: one row ``(key, ts, seq, good, gap, decay, trust, score)`` per event.

    Events of a key are taken in the order of ``(ts, seq)``. The first one starts from ``start`` without decay; later
    ones first decay by exp(-rate * gap). A good event then adds ``reward`` of the distance to 100, a bad one keeps the
    share ``keep``. ``score`` is the trust rounded half to even. ``gap`` (in ``unit``) and ``decay`` are null for the
    first event. A null key is a key like any other; a missing time is ``now`` (the time of the query if not given).
    ``state`` holds ``(key, trust, ts)`` of earlier batches, whose events must not be later than these, or with ``strict``
    ``(key, trust, ts, seq)``: then events that are not after their key's state in (ts, seq) have ``late`` set, which is a
    further column, and no trust; and of events with one key, ts and seq the first is taken. A state is one more row of
    its key's timeline, so events are shuffled once whether there is a state or not.

    Runs one counting job first, to find the keys that need slicing; if there are any, the events are written once for
    all that follows.
    """
    if not (0 <= reward <= 1 and 0 <= keep <= 1 and rate >= 0):
        raise ValueError("reward and keep must be in [0, 1] and rate must not be negative")
    rate_us = rate / MICROS[unit]
    now = F.current_timestamp() if now is None else now
    events = events.withColumn(ts, F.coalesce(F.col(ts), now.cast(events.schema[ts].dataType)))
    steps = events.select(
        key, ts, seq, micros(events, ts).alias("_us"), F.coalesce(good, F.lit(False)).alias("_good"),
        F.lit(None).cast("double").alias("_set"),
    )
    if state is not None:
        at = state.select(
            key, F.col(ts).cast(steps.schema[ts].dataType).alias(ts),
            (F.col(seq) if strict else F.lit(None)).cast(steps.schema[seq].dataType).alias(seq),
            micros(state, ts).alias("_us"), F.lit(False).alias("_good"), F.col("trust").alias("_set"))
        steps = steps.unionByName(at)
    order = [F.col(key), F.col("_set").isNull(), F.col("_us"), F.col(seq)]

    sizes = steps.groupBy(key).count().where(F.col("count") > slice_rows)
    n_hot, hot_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    ordinary = steps
    if n_hot:
        hot_keys = materialise(sizes.select(key), "hot-keys")
        steps = materialise(steps, "steps")  # read several times from here on
        if n_hot <= BROADCAST_KEYS:
            hot_keys = F.broadcast(hot_keys)
        ordinary = on_key(steps, hot_keys, key, "left_anti")

    fold = (seq, rate_us, reward, keep, strict)
    folded = _with_prefix(ordinary.repartition(F.col(key)).sortWithinPartitions(*order), key, *fold)
    folded = folded.withColumn("_x0", F.lit(None).cast("double")).withColumn("_t0", F.lit(None).cast("bigint"))

    if n_hot:
        # A slice costs no memory, so their number may stop at a few for each task that can run.
        most = 4 * max(_shuffle_width(events), events.sparkSession.sparkContext.defaultParallelism)
        slices = min(math.ceil(hot_rows / slice_rows), most)
        hot, late = on_key(steps, hot_keys, key, "left_semi"), None
        if strict and state is not None:
            # Only the first slice of a key holds its state; for the others late events are sorted out before.
            last = hot.where(F.col("_set").isNotNull()).select(key, F.struct("_us", seq).alias("_last"))
            met = on_key(hot, F.broadcast(last) if n_hot <= BROADCAST_KEYS else last, key, "left")
            is_late = F.col("_set").isNull() & F.coalesce(F.struct("_us", seq) <= F.col("_last"), F.lit(False))
            late, hot = met.where(is_late).drop("_last"), met.where(~is_late).drop("_last")
        cut = hot.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("_slice", F.spark_partition_id())
        # Range borders come from a sample, so they are fixed on storage before two readers rely on them.
        sliced = materialise(_with_prefix(cut, key, *fold), "slices")
        entries = _slice_entries(sliced, key, seq, rate_us, start)
        if slices + n_hot <= BROADCAST_KEYS:
            entries = F.broadcast(entries)
        folded = folded.unionByName(on_key(sliced, entries, key, "inner", "_slice").drop("_slice"))
        if late is not None:
            folded = folded.unionByName(late.withColumn("_skip", F.lit(LATE)), allowMissingColumns=True)

    entry = _entry(F.col("_x0"), F.col("_t0"), F.col("_first_us"), rate_us, start)
    late = F.col("_skip") == LATE
    gap_us = F.when(~late, F.coalesce(F.col("_gap_us"), F.col("_us") - F.col("_t0")))
    trust = F.when(~late, clamp(F.col("_a") * entry + F.col("_b")))
    return folded.where(F.col("_set").isNull() & (F.col("_skip") != AGAIN)).select(
        key, ts, seq, F.col("_good").alias("good"),
        (gap_us / F.lit(float(MICROS[unit]))).alias("gap"),
        F.exp(-rate_us * gap_us).alias("decay"),
        trust.alias("trust"),
        *([late.alias("late")] if strict else []),
    ).withColumn("score", round_half_even(F.col("trust")))


_TIMES = (T.TimestampType, T.TimestampNTZType)
_SMALL = (T.ByteType, T.ShortType, T.IntegerType)
_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, *_TIMES)
_FIRST, _LEAST = -4 * 10**18, -(2**63)


def _order_number(df: DataFrame, order: tuple[str, ...]) -> Column | None:
    """Columns that order rows as one number, nulls first; none if they do not fit into one. Two columns share a decimal:
    the first one in microseconds or a small number, the second one of 64 bits."""
    types = [df.schema[c].dataType for c in order]

    def whole(name: str, kind: T.DataType, null: int) -> Column:
        value = micros(df, name) if isinstance(kind, _TIMES) else F.col(name).cast("bigint")
        return F.coalesce(value, F.lit(null).cast("bigint"))

    if not isinstance(types[-1], (*_TIMES, *_SMALL, T.LongType)):
        return None
    if len(order) == 1:
        return whole(order[0], types[0], _LEAST)
    if len(order) > 2 or not isinstance(types[0], (*_TIMES, *_SMALL)):
        return None
    high, low = whole(order[0], types[0], _FIRST), whole(order[1], types[1], _LEAST)
    return high.cast("decimal(20,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + low.cast("decimal(20,0)")


def latest(scores: DataFrame, *, key: str, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """The newest ``values`` per key. ``max_by`` combines on the map side, so a key of any size moves one row per task. An
    order that fits into one number, and values of fixed size, make it a hash aggregate; others are sorted first."""
    number = _order_number(scores, order)
    if number is not None and all(isinstance(scores.schema[v].dataType, _FIXED) for v in values):
        rows = scores.select(key, *(F.col(v).alias(f"_{v}") for v in values), number.alias("_order"))
        return rows.groupBy(key).agg(*(F.max_by(f"_{v}", "_order").alias(v) for v in values))
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return scores.groupBy(key).agg(newest.alias("_newest")).select(key, *[f"_newest.{v}" for v in values])


def read_scores(keys: DataFrame, scores: DataFrame, *, key: str, default: int) -> DataFrame:
    """The score of each requested key: 50 is the default of the running fold, 0 that of a ledger."""
    found = keys.select(key).distinct().join(scores.select(key, "trust"), key, "left")
    return found.select(key, round_half_even(F.coalesce(F.col("trust"), F.lit(float(default)))).alias("score"))


def known_entities(events: DataFrame, registry: DataFrame, *, key: str, registry_key: str) -> DataFrame:
    """Events of registered entities, with nothing added."""
    return events.join(registry.select(F.col(registry_key).alias(key)).distinct(), key, "left_semi")


def with_account(
    events: DataFrame, registry: DataFrame, *, key: str, registry_key: str, account: str
) -> DataFrame:
    """Every event with the ``account`` of its entity, null where it is not registered. One entity has one account: the
    smallest if the registry lists several."""
    accounts = registry.groupBy(F.col(registry_key).alias(key)).agg(F.min(account).alias(account))
    return events.join(accounts, key, "left")


def unknown_entities(events: DataFrame, registry: DataFrame, *, key: str, registry_key: str) -> DataFrame:
    """Events that are scored but never reach the ledger."""
    return events.join(registry.select(F.col(registry_key).alias(key)).distinct(), key, "left_anti")
