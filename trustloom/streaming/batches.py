"""Per-batch folders: every micro-batch owns ``batch=<id>`` and replaces it when run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def put(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write ``df`` as the folder of the batch and go on from what was written."""
    folder = f"{path}/batch={batch_id}"
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def get(spark: SparkSession, path: str, schema: str, first: int = 0, before: int | None = None) -> DataFrame:
    """Rows of the batches ``first`` <= id < ``before``, with their ``batch``. Folders outside are not read."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")
    rows = rows.where(F.col("batch") >= first)
    return rows if before is None else rows.where(F.col("batch") < before)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start ``step`` on what is available now; a later start goes on from the checkpoint. A step reads its batch several
    times; it is kept meanwhile, so that what stands before it runs once (a lost part is computed again)."""

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(kept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
