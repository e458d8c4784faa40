"""The corpus pipeline: documents in, tokens of good, distinct, uncontaminated documents out.

Each stage takes all documents that the one before it kept, written as Parquet and read again. Rows that a stage keeps
have the columns of ``documents``; the last stage returns tokens. Null texts have no words, tokens or lines and are
judged like empty ones; they pass unless the quality stage rejects them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.bpe import bpe_encode
from trustloom.llm.decontaminate import decontaminate as find_passages
from trustloom.llm.line_dedup import line_dedup as drop_boilerplate
from trustloom.llm.near_dedup import near_duplicates
from trustloom.llm.quality import fit_on, keep_quality
from trustloom.llm.rows import column, packed, table
from trustloom.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours are mostly bad ones (a score below 0.3) go."""
    return keep_quality(docs, fit_on(spark, docs, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; ``n_chars`` follows if there is one. Copies are one page, or a large group of
    them would lose all its lines before ``near_dedup`` can keep one; two pages are the least a line must be on. All other
    columns stay as they are, whatever their names."""
    rows = packed(docs).select("row", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    cleaned = drop_boilerplate(rows, distinct_pages=True, min_pages=2)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, n_chars).otherwise(F.col("row.n_chars"))
    return cleaned.select(*(changed.get(c, column(c, "row")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Rows with one id and one text are one
    document and stay once; where no document of a group has an id, one of each text stays. Texts are shuffled once to
    be compared and once to be kept."""
    found = near_duplicates(docs)
    key = [F.coalesce("doc_id", F.lit(-1)).alias("key"), F.col("doc_id").isNull().alias("none"), "print"]
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(*key).distinct()
    rows = packed(docs).select("row", F.col("row.doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("print"))
    stay = rows.select("row", *key).join(kept, ["key", "none", "print"], "left_semi")
    return stay.dropDuplicates(["key", "none", "print"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; others with their id, or without one like them, stay."""
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    key = [F.coalesce("doc_id", F.lit(-1)).alias("key"), F.col("doc_id").isNull().alias("none"), "print"]
    bad = found.where("contaminated").select(*key).distinct()
    rows = packed(docs).select("row", F.col("row.doc_id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("print"))
    return rows.select("row", *key).join(bad, ["key", "none", "print"], "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each remaining document."""
    return bpe_encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# SQL can express neither the quality stage, which learns a model, nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
