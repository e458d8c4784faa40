"""Articles as trust events, and the log of submissions. Both have the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.constants import SOURCE_EVENT_COLUMNS


def article_events(articles: DataFrame) -> DataFrame:
    """(source_id, title, text, prediction, timestamp) from articles (source, title, text, timestamp) whose prediction
    is the ``label`` column where there is one, else the ``prediction`` column. A value that is no number is an error."""
    flag = "label" if "label" in articles.columns else "prediction"
    return articles.select(
        F.col("source").alias("source_id"), "title", "text", F.col(flag).cast("int").alias("prediction"), "timestamp"
    )


def submission_rows(scored: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Log rows of scored submissions (source_id, text, prediction). What could not be scored (null or -1) is left
    out; the time is that of the submission, or ``now``."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    for column, default in (("title", F.lit(None).cast("string")), ("timestamp", now)):
        if column not in scored.columns:
            scored = scored.withColumn(column, default)
    return scored.where(F.col("prediction").isin(0, 1)).withColumn(
        "timestamp", F.coalesce("timestamp", now)
    ).select(*SOURCE_EVENT_COLUMNS)


def write_events(events: DataFrame, path: str, *, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Event table as parquet, or CSV with header. ``mode='append'`` adds to a log."""
    writer = events.select(*SOURCE_EVENT_COLUMNS).write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    writer.format(fmt).save(path)
