"""Scores of a trust stream into the ledger."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustloom.sources.ledger import Ledger
from trustloom.streaming.batches import run_batches


def ledger_stream(history: DataFrame, ledger: Ledger, checkpoint: str, *, key: str) -> StreamingQuery:
    """Upsert the newest score per key of each micro-batch of trust rows (key, ts, seq, score): one write per key and
    batch in place of one per event. A batch run again replaces its own writes; each checkpoint is a stream of its own."""
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def step(batch: DataFrame, batch_id: int) -> None:
        writes = batch.select(F.col(key).alias("entity"), "score", "ts", "seq", F.lit(ledger.owner).alias("writer"))
        ledger.write(writes, batch_id, stream)

    return run_batches(history, step, checkpoint)
