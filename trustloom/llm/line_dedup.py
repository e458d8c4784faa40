"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.rows import column, packed, table, unpacked
from trustloom.session import materialise

SALTS = 32
# Fingerprints of 32 characters and their host: about 10 MB.
BROADCAST_LINES = 100_000


def _lines(text: Column) -> Column:
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def boilerplate(
    docs: DataFrame, text: str, host: str, max_ratio: float, min_pages: int, distinct_pages: bool = False
) -> DataFrame:
    """Rows (host, line): the fingerprint of every line that is on more than ``max_ratio`` of its host's pages.

    A line counts once per page (made distinct inside the row) and is combined before the shuffle, so neither a line
    nor a host that holds a third of all rows meets in one task. The few lines with enough pages are then joined to the
    pages per host, a host spread over ``SALTS`` parts. With ``distinct_pages`` lines and pages are first made distinct
    by host and fingerprint of the page's text, which spreads a line over all pages that have it.
    """
    pages = packed(docs).select(column(host, "row").alias("host"), column(text, "row").alias("text"))
    pages = pages.where(F.col("host").isNotNull())
    distinct = F.array_distinct(F.transform(_lines(F.col("text")), F.trim))
    text_print = F.xxhash64(F.coalesce("text", F.lit(""))) if distinct_pages else F.lit(0).cast("long")
    lines = pages.select("host", text_print.alias("print"), F.explode_outer(distinct).alias("line"))
    lines = lines.where(F.col("line") != "").select("host", F.md5("line").alias("line"), "print")
    pages = pages.select("host", text_print.alias("print"))
    if distinct_pages:
        lines, pages = lines.distinct(), pages.distinct()
    on_pages = (
        lines.groupBy("host", "line")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
        .withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int"))
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    totals = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return (
        on_pages.join(totals, ["host", "salt"])
        .where(F.col("pages") > F.lit(max_ratio) * F.col("total"))
        .select("host", "line")
    )


def line_dedup(
    docs: DataFrame, *, text: str = "text", host: str = "source", max_ratio: float = 0.05, min_pages: int = 5,
    distinct_pages: bool = False, broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` with the boilerplate lines of each host taken out of ``text``; ``n_lines`` and ``n_dropped`` are added
    (they replace columns of those names).

    A line is boilerplate if it is on at least ``min_pages`` pages of the host and on more than ``max_ratio`` of them.
    Lines are cut at line feeds and compared without blanks at their ends; a line said twice on a page counts once, and
    blank lines always stay. A page without host belongs to no site and keeps all its lines. Null text stays null with
    no lines; empty text has one blank line. A text that loses all its lines becomes empty. Repeated rows each count as
    a page and each come back. Rows are neither added nor lost. With ``distinct_pages`` rows of a host with equal texts
    count as one page together (null and empty texts are equal), so copies of a page cannot make its lines boilerplate.

    A host has at most (mean lines per page) / ``max_ratio`` boilerplate lines, so they fit in one array. The arrays are
    broadcast up to ``broadcast_lines`` lines in all, and texts then are never shuffled; beyond, they are joined by
    host, with each host spread over ``SALTS`` parts.
    """
    bad = materialise(boilerplate(docs, text, host, max_ratio, min_pages, distinct_pages), "boilerplate")
    per_host = bad.groupBy("host").agg(F.collect_list("line").alias("bad"))
    rows = packed(docs).withColumn("host", column(host, "row"))
    if bad.count() <= broadcast_lines:
        joined = rows.join(F.broadcast(per_host), "host", "left")
    else:
        salted = per_host.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salt = F.pmod(F.xxhash64(column(text, "row")), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    joined = joined.withColumn("lines", _lines(column(text, "row")))
    clean = F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("bad", F.md5(F.trim(x))))
    joined = joined.withColumn("kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(clean))
    n_lines, n_kept = F.size("lines").cast("long"), F.size("kept").cast("long")
    new_text = F.when(n_kept < n_lines, F.array_join("kept", "\n")).otherwise(column(text, "row"))
    return joined.select(
        *(
            new_text.alias(c) if c == text else column(c, "row").alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_dropped")
        ),
        n_lines.alias("n_lines"),
        (n_lines - n_kept).alias("n_dropped"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}

ORACLES = {
    "op1_line_dedup": """
WITH cut AS (
    SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines
    FROM documents),
on_pages AS (
    SELECT source, line, count(*) AS pages
    FROM (SELECT source, unnest(list_distinct([trim(x) FOR x IN lines])) AS line FROM cut WHERE source IS NOT NULL)
    WHERE line <> '' GROUP BY source, line),
bad AS (
    SELECT source, list(line) AS bad
    FROM on_pages JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) USING (source)
    WHERE pages >= 5 AND pages > CAST(0.05 AS DOUBLE) * total GROUP BY source),
kept AS (
    SELECT doc_id, text, lines, [x FOR x IN lines IF trim(x) = '' OR bad IS NULL OR NOT list_contains(bad, trim(x))] AS kept
    FROM cut LEFT JOIN bad USING (source))
SELECT doc_id, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
    sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM kept"""
}
