"""Benchmark passages in documents, by a prefix-filtered join of word shingles."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.rows import column, packed, table
from trustloom.session import materialise

# What separates words once A-Z are lower-cased: ASCII that is neither digit nor small letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows in one broadcast: some 40 MB. A larger benchmark is probed in blocks of so many.
BLOCK_WINDOWS = 100_000


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case and all other letters as they are. Null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Rows (win, items, size, k): each distinct run of ``window`` words (or a shorter item as a whole), who has it, how
    many words it has and how many a shingle of it has."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - window, F.lit(0)) + 1)
    runs = items.where(n > 0).select("item", "words", F.explode_outer(starts).alias("at"))
    runs = runs.select("item", F.slice("words", F.col("at"), F.least(n, F.lit(window))).alias("win"))
    runs = runs.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    size = F.size("win")
    return runs.select("win", "items", size.alias("size"), F.least(size, F.lit(shingle)).alias("k"))


def _shingles(windows: DataFrame, k: int) -> DataFrame:
    """Every shingle of the windows with its place there, one row each."""
    at = F.explode_outer(F.sequence(F.lit(0), F.col("size") - k)).alias("offset")
    return windows.where(F.col("k") == k).select("*", at).withColumn(
        "key", F.xxhash64(*(F.get("win", F.col("offset") + j) for j in range(k))))


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """A row for each word of each document with the key of the shingle that begins there, and one row at -1. The words
    stay an array in the same row, so nothing is copied and a hit can be verified where it is found."""
    at = F.explode_outer(F.sequence(F.lit(-1), F.col("n") - 1)).alias("pos")
    key = F.xxhash64(*(F.get("words", F.col("pos") + j) for j in range(k)))
    inside = (F.col("pos") >= 0) & (F.col("pos") + k <= F.col("n"))
    return docs.select("*", at).withColumn("key", F.when(inside, key))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 10, shingle: int = 3, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``n_hit``, ``items`` (ids of the benchmark items with a window in it, as sorted
    strings), ``spans`` (start and length of every window found), ``contaminated`` (any word hit) and ``print`` (xxhash64
    of the text, null as empty), which tells apart documents that share an id or have none.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. Containment is exact, so of a
    window's shingles, ordered by how rare they are in all documents, the rarest one alone is a necessary prefix: a
    document that has the window has that shingle. Where a document has it, its place in the window gives the start;
    the start must leave room for the whole window (the length and position bounds), and the words are then compared.

    Documents are read twice, once to count the benchmark's shingles and once to probe; their texts are never shuffled,
    only hits are. The windows are broadcast, ``block_windows`` at a time. A null or empty text has no words; a null or
    wordless item has no windows; a null item id is never listed. Equal windows of several items count for each of
    them. Each row of ``docs`` gives one row, also rows that are repeated, and rows with null ids. No documents, no
    rows; an empty benchmark hits nothing. Other columns of ``docs`` play no part.
    """
    tokens = packed(docs).select(
        column(id, "row").alias("id"), words(column(text, "row")).alias("words"), column(text, "row").alias("text"))
    tokens = tokens.select(
        "id", "words", F.size("words").alias("n"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    items = packed(benchmark).select(
        column(item_id, "row").cast("string").alias("item"), words(column(item_text, "row")).alias("words"))
    windows = materialise(_windows(items, window, shingle), "windows")
    lengths = [r.k for r in windows.select("k").distinct().orderBy("k").collect()]  # at most ``shingle`` numbers

    found = tokens.select("id", "n", "print", F.lit(1).alias("copies"), *_no_hit(windows))
    for k in lengths:
        grams = _shingles(windows, k)
        probes = _positions(tokens, k)
        blocks = range(max(1, -(-windows.where(F.col("k") == k).count() // block_windows)))
        block = F.pmod(F.xxhash64("win"), F.lit(len(blocks)))
        counts = None
        for b in blocks:
            keys = F.broadcast(grams.where(block == b).select("key").distinct())
            some = probes.select("key").join(keys, "key").groupBy("key").agg(F.count("*").alias("seen"))
            counts = some if counts is None else counts.unionByName(some)
        # A shingle of windows in several blocks was counted in each of them alike.
        counts = counts.groupBy("key").agg(F.max("seen").alias("seen"))
        rarity = F.struct(F.coalesce("seen", F.lit(0)), "offset", "key")
        prefix = grams.join(counts, "key", "left").groupBy("win", "items", "size").agg(F.min(rarity).alias("first"))
        prefix = materialise(
            prefix.select("win", "items", "size", F.col("first.offset").alias("offset"), F.col("first.key").alias("key")),
            "prefixes")
        for b in blocks:
            hit = probes.join(F.broadcast(prefix.where(block == b)), "key")
            start = F.col("pos") - F.col("offset")
            fits = (start >= 0) & (start + F.col("size") <= F.col("n"))
            hit = hit.where(F.when(fits, F.slice("words", start + 1, F.col("size")) == F.col("win")).otherwise(False))
            found = found.unionByName(hit.select(
                "id", "n", "print", F.lit(0).alias("copies"), F.struct(start.alias("start"), F.col("size")).alias("span"),
                "items"))
    per_doc = found.groupBy("id", "n", "print").agg(
        F.sum("copies").cast("int").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"),
        F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    per_doc = per_doc.select(
        F.col("id").alias(id),
        F.col("n").cast("long").alias("n_words"),
        F.size(covered).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
        "print",
        F.explode_outer(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return per_doc.drop("copy")


def _no_hit(windows: DataFrame) -> list[Column]:
    return [
        F.lit(None).cast("struct<start:int,size:int>").alias("span"),
        F.lit(None).cast(windows.schema["items"].dataType).alias("items"),
    ]


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op2_decontaminate": op2_decontaminate}

ORACLES = {
    "op2_decontaminate": r"""
WITH cut AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws
    FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT item_id, least(len(ws), 10) AS size, ws[s : s + least(len(ws), 10) - 1] AS win
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS s FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
    SELECT doc_id, s, size, ws[s : s + size - 1] AS win
    FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM cut, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, s, size, item_id FROM runs JOIN windows USING (size, win)),
hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""
}
