"""Trust as a stream: the batch fold per micro-batch, with the state of the keys as a table.

The fold of a micro-batch is the batch operator itself, so a key that fills a third of a batch is sliced there too. The
state of a key joins the fold as a row of its timeline, which also tells what comes late and what comes again: events
are shuffled once. State is written per batch: the keys the batch touched, and all keys every ``full_every`` batches, so that reading it back
looks at a bounded number of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustloom.operators.reputation import latest, on_key, trust_fold
from trustloom.streaming.batches import get, put, run_batches


def _state(spark, out: str, schema: str, key: str, batch_id: int, full_every: int) -> DataFrame | None:
    """(key, trust, ts, seq) before ``batch_id``, newest per key."""
    if batch_id == 0:
        return None
    first = (batch_id - 1) // full_every * full_every
    deltas = get(spark, f"{out}/state", schema, first, batch_id)
    return latest(deltas, key=key, order=("batch",), values=("trust", "ts", "seq"))


def trust_stream(
    events: DataFrame,
    out: str,
    checkpoint: str,
    *,
    key: str,
    ts: str,
    seq: str,
    good: Column,
    full_every: int = 20,
    **params,
) -> StreamingQuery:
    """Fold a stream of events into ``out``/history, /state and /late, one folder per micro-batch.

    Inside a batch events are taken by ``(ts, seq)``. An event that is not after the last one folded for its key, in that
    order, is written to /late and never folded: the batch fold over all events is the truth for those. This also
    keeps an event out that an upstream retry delivers again; one that a batch holds twice is folded once.
    """
    spark = events.sparkSession
    types = dict(events.dtypes)
    state_schema = f"{key} {types[key]}, trust double, ts timestamp_ntz, seq {types[seq]}"

    def step(batch: DataFrame, batch_id: int) -> None:
        at = F.coalesce(F.col(ts), F.current_timestamp()).cast("timestamp_ntz")
        rows = batch.select(key, at.alias("ts"), F.col(seq).alias("seq"), good.alias("good"))
        state = _state(spark, out, state_schema, key, batch_id, full_every)
        folded = trust_fold(
            rows, key=key, ts="ts", seq="seq", good=F.col("good"), state=state, strict=True, **params).persist()
        if state is not None:
            put(folded.where("late").select(key, "ts", "seq", "good"), f"{out}/late", batch_id)
        history = put(folded.where("NOT late").drop("late"), f"{out}/history", batch_id)
        folded.unpersist()
        touched = latest(history, key=key, order=("ts", "seq"), values=("trust", "ts", "seq"))
        if state is not None and batch_id % full_every == 0:
            touched = touched.unionByName(on_key(state, touched.select(key), key, "left_anti"))
        put(touched, f"{out}/state", batch_id)

    return run_batches(events, step, checkpoint)


def trust_history(spark, out: str, key: str, key_type: str, seq_type: str = "bigint") -> DataFrame:
    """All rows folded so far."""
    fields = f"{key} {key_type}, ts timestamp_ntz, seq {seq_type}, good boolean, gap double, decay double, trust double"
    return get(spark, f"{out}/history", f"{fields}, score int")
