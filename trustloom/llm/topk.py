"""Exact top-k by inner product, dimension block by dimension block in vertical layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.rows import column, table

CANDIDATES, QUERIES_AT_ONCE = 16_384, 4_096
TILE = 128


def _vertical(vectors: pa.ChunkedArray, n: int) -> np.ndarray:
    """Equally long lists as a matrix with a row per dimension."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(n, -1).T.astype(np.float64))


def best_of_block(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, block: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best candidates of each query among ``c`` (dimensions x candidates), as (query, candidate, score) rows.

    Dimensions are added block by block. What the remaining ones can still add or take is at most the product of the two
    remaining lengths (their remaining mass), so a candidate goes as soon as its score so far plus that bound is below
    the k-th best lower bound; the survivors are moved together before the next block. The first dimensions are those
    with most mass, and a first threshold comes from the longest candidates in full. Whole numbers below 2^53 are exact
    in float64, and bounds get one unit of slack.
    """
    dims, n = c.shape
    by_mass = np.argsort(-(c * c).sum(axis=1) - (q * q).sum(axis=1), kind="stable")
    c, q = np.ascontiguousarray(c[by_mass]), np.ascontiguousarray(q[by_mass])
    cuts = [*range(0, dims, block), dims]
    # rest[b]: the length of what is left from cut b on.
    rest_c = [np.sqrt((c[a:] ** 2).sum(axis=0)) for a in cuts]
    rest_q = [np.sqrt((q[a:] ** 2).sum(axis=0)) for a in cuts]
    seeds = np.argsort(-rest_c[0], kind="stable")[: max(8 * k, 512)]
    out_q, out_c, out_s = [], [], []
    for lo in range(0, q.shape[1], TILE):
        tile = slice(lo, min(lo + TILE, q.shape[1]))
        first = q[cuts[0] : cuts[1], tile].T @ c[cuts[0] : cuts[1]]
        full = q[:, tile].T @ c[:, seeds]
        for row, i in enumerate(range(tile.start, tile.stop)):
            # A query's own vector is no candidate: it takes no part in thresholds.
            others = full[row][c_ids[seeds] != q_ids[i]]
            least = np.partition(others, -k)[-k] if len(others) >= k else -np.inf
            alive, score = np.arange(n), first[row]
            for b in range(1, len(cuts)):
                if b > 1:
                    score = score + q[cuts[b - 1] : cuts[b], i] @ c[cuts[b - 1] : cuts[b]][:, alive]
                reach = rest_q[b][i] * rest_c[b][alive] + (1.0 if b < len(cuts) - 1 else 0.0)
                keep = score + reach >= least
                if b == 1:
                    keep &= c_ids != q_ids[i]
                alive, score, reach = alive[keep], score[keep], reach[keep]
                if len(alive) > k:
                    least = max(least, np.partition(score - reach, -k)[-k])
            order = np.lexsort((c_ids[alive], -score))[:k]
            out_q.append(np.full(len(order), q_ids[i]))
            out_c.append(c_ids[alive[order]])
            out_s.append(score[order])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def top_k(
    vectors: DataFrame, queries: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 20, block: int = 16,
    candidates_at_once: int = CANDIDATES, queries_at_once: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """For each row of ``vectors`` for which ``queries`` (a condition on its columns) holds, the ``k`` other rows with the
    highest inner product: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    Components must be whole numbers whose products add up to less than 2^53. The candidates are dealt into blocks of
    about ``candidates_at_once`` and the queries into blocks of about ``queries_at_once``; each pair of blocks is one
    group, so the memory of a task does not grow with the table. A group returns its k best per query, and the best of
    those are ranked by a window.

    Null and empty vectors, vectors with a null component, and rows with a null id take no part; neither do pairs of vectors of
    different length. Of rows that share an id each is a candidate of its own, but not for queries of that id, and their
    queries are one: its result is the best of what any of them finds. A query without other rows has no result; one with
    fewer than ``k`` has them all. No rows, no result.
    """
    rows = vectors.select(
        column(id).cast("long").alias("id"),
        F.transform(column(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    rows = rows.where(usable)
    total, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0))).first()
    n_c, n_q = max(1, -(-total // candidates_at_once)), max(1, -(-asked // queries_at_once))

    # By row, not by id or vector: rows repeated any number of times spread over all blocks. A column of its own, so that
    # a row's copies have one place.
    rows = rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    place = F.col("place")
    shared = [F.size("v").alias("size"), "id", "v"]
    every = lambda n, name: F.explode_outer(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    candidates = rows.select(
        *shared, F.lit(False).alias("asks"), F.pmod(place, F.lit(n_c)).cast("int").alias("c"), every(n_q, "q"))
    asking = rows.where("q").select(
        *shared, F.lit(True).alias("asks"), every(n_c, "c"), F.pmod(place, F.lit(n_q)).cast("int").alias("q"))

    def best(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        parts = []
        for side in (asks, ~asks):
            part = group.filter(pa.array(side))
            parts += [part.column("id").to_numpy(), _vertical(part.column("v"), part.num_rows) if part.num_rows else None]
        q_ids, q, c_ids, c = parts
        if q is None or c is None:
            empty = np.zeros(0, np.int64)
            return pa.table({"query_id": empty, "vec_id": empty, "score": empty})
        found_q, found_c, score = best_of_block(q_ids, q, c_ids, c, k, block)
        return pa.table({"query_id": found_q, "vec_id": found_c, "score": score.astype(np.int64)})

    found = candidates.unionByName(asking).groupBy("size", "c", "q").applyInArrow(
        best, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``vectors`` with each component x as floor(scale * x); a vector with a null or non-finite component becomes null."""
    values = F.transform(column(vector), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    scaled = F.when(~bad, F.transform(values, lambda x: F.floor(x * scale)))
    return vectors.withColumn(vector, scaled)


def op4_topk(spark, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {"op4_topk": op4_topk}

ORACLES = {
    "op4_topk": """
WITH usable AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id,
        score
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
}
