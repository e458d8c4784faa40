"""Score ledger: an append-only table of writes and its latest-per-key view.

Every attempt to take a batch writes folders of its own, accepted and refused rows, and then one row to the log of
commits, which makes both visible together. The row carries a number that grows with every commit of any stream, so the
last write per entity is known across streams. A batch that is run again replaces its own commit under the same number
and changes nothing; an attempt that is killed before its commit is never seen.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators.reputation import latest

WRITES = "entity string, score int, ts timestamp_ntz, seq bigint, writer string"
PLACE = "stream string, batch bigint, attempt string"
BASE = -1  # the number of what a compacted ledger begins with


@dataclass
class Ledger:
    spark: SparkSession
    path: str
    owner: str

    def write(self, writes: DataFrame, batch: int, stream: str = "main") -> None:
        """Take ``writes`` (entity, score, ts, seq, writer) as batch number ``batch`` of ``stream``. Only the owner may write and a
        score is not negative; one row per entity is kept, the newest. Refused rows go to the audit table. Writers that
        commit at the same moment may get the same number; their writes are then told apart by time."""
        self._write(writes, batch, stream, None)

    def _write(self, writes: DataFrame, batch: int, stream: str, number: int | None) -> None:
        rows = writes.select(
            F.col("entity").cast("string"), F.col("score").cast("int"), "ts", F.col("seq").cast("bigint"), "writer"
        ).persist()
        allowed = F.coalesce((F.col("writer") == self.owner) & (F.col("score") >= 0), F.lit(False))
        newest = latest(rows.where(allowed), key="entity", order=("ts", "seq"), values=("score", "ts", "seq"))
        place = f"stream={stream}/batch={batch}"
        attempt = uuid.uuid4().hex
        newest.withColumn("writer", F.lit(self.owner)).write.parquet(f"{self.path}/accepted/{place}/attempt={attempt}")
        self._refused(rows, allowed).write.parquet(f"{self.path}/refused/{place}/attempt={attempt}")
        rows.unpersist()
        if number is None:
            number = self._number(batch, stream)
        commit = self.spark.createDataFrame([(number, attempt)], "number int, attempt string")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{place}")

    def _number(self, batch: int, stream: str) -> int:
        """That of the batch if it was taken before, else the next one."""
        same = (F.col("batch") == batch) & (F.col("stream") == stream)
        own, last = self.commits().agg(F.max(F.when(same, F.col("number"))), F.max("number")).first()
        return own if own is not None else 0 if last is None else last + 1

    def commits(self) -> DataFrame:
        """(number, attempt, stream, batch): one row per batch taken."""
        return self._read("commits", "number int, attempt string, stream string, batch bigint")

    def _refused(self, rows: DataFrame, allowed: Column) -> DataFrame:
        reason = F.when(F.col("writer").eqNullSafe(F.lit(self.owner)), "score must not be negative").otherwise(
            "only the owner can set a score"
        )
        return rows.where(~allowed).withColumn("reason", reason)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _table(self, name: str, schema: str) -> DataFrame:
        """The rows of what is committed, with ``number``."""
        return self._read(name, f"{schema}, {PLACE}").join(self.commits(), ["stream", "batch", "attempt"]).drop("attempt")

    def history(self) -> DataFrame:
        return self._table("accepted", WRITES)

    def refused(self) -> DataFrame:
        return self._table("refused", f"{WRITES}, reason string")

    def latest(self) -> DataFrame:
        """(entity, score, ts, seq): last write per entity, in the order of commits. A commit has one row per entity."""
        return latest(self.history(), key="entity", order=("number", "ts"), values=("score", "ts", "seq"))

    def read(self, keys: DataFrame, default: int = 0) -> DataFrame:
        """(entity, score) for the requested entities; one never written reads ``default``."""
        asked = keys.select(F.col("entity").cast("string")).distinct()
        found = asked.join(self.latest().select("entity", "score"), "entity", "left")
        return found.select("entity", F.coalesce("score", F.lit(default)).alias("score"))

    def compact(self, into: str) -> Ledger:
        """A ledger at ``into`` that holds the latest writes as its only batch, to bound the number of files. That batch
        comes before all that are written later, from number 0 on."""
        compacted = Ledger(self.spark, into, self.owner)
        compacted._write(self.latest().withColumn("writer", F.lit(self.owner)), BASE, "base", BASE)
        return compacted
