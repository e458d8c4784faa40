"""Word vectors, document means and class prototypes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from trustloom.functions.digests import Heads
from trustloom.functions.scalar import argmax_verdict, cosine, dot
from trustloom.operators import lookup, pair_cells
from trustloom.operators.pair_cells import Cells
from trustloom.operators.vocabulary import UNKNOWN_ID, skipgrams, training_pairs, word_ids
from trustloom.session import materialise

# Numbers in the broadcast part of a vector table: 64 MB. Words whose vectors a task adds up at a time.
HOT_NUMBERS, WORDS_AT_ONCE = 8_000_000, 50_000
# Words of one range at least whose vectors are held while training. Entries of a cell of pairs, and partners of a word
# whose vectors are gathered at a time.
LEAST_HELD, CELL_ENTRIES, PARTNERS_AT_ONCE = 1000, 2_000_000, 2048
# Vectors start with numbers between -SPREAD and SPREAD, of so many different ones. Digests that are taken at a time.
SPREAD, DRAWS, DIGESTS_AT_ONCE = 0.05, 1 << 20, 16_384


def _start(ids: DataFrame, dim: int, seed: int) -> DataFrame:
    """(id, vec, power): small numbers drawn from digests of the id, the same on every run, and no way moved yet."""
    digests = (dim + 1) // 2  # two numbers each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, some = Heads([f"{seed}|"]), max(DIGESTS_AT_ONCE // digests, 1)
        for batch in (b.slice(i, some) for b in batches for i in range(0, b.num_rows, some)):
            first = np.repeat(batch.column(0).to_numpy().astype(np.int64), digests)
            second = np.tile(np.arange(digests), batch.num_rows)
            drawn = np.stack(head.draws(np.zeros(len(first), np.int64), first, second), axis=1).reshape(batch.num_rows, -1)
            vec = ((drawn[:, :dim] % np.uint64(DRAWS)).astype(np.float64) / DRAWS - 0.5) * (2 * SPREAD)
            offsets = pa.array(np.arange(len(vec) + 1, dtype=np.int32) * dim)
            found = [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(vec.ravel())), pa.array(np.zeros(len(vec)))]
            yield pa.record_batch(found, names=["id", "vec", "power"])

    schema = StructType([*ids.select("id").schema]).add("vec", ArrayType(DoubleType())).add("power", DoubleType())
    return ids.select("id").mapInArrow(run, schema)


def pair_weights(counted: DataFrame, cells: Cells) -> DataFrame:
    """Rows of ``pair_cells.PACKED``, written by batch and ranges: for each word its partners, and how often it stood in a
    true and in a drawn pair with them, in either role. ``counted`` are counts of ``training_pairs``; those of a cell are
    put together in one task, a few at a time."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pair_cells.packed(cells, key[0].as_py(), batches)

    return materialise(counted.groupBy("cell").applyInArrow(run, pair_cells.PACKED), "pair-weights", by=["batch", "at_a", "at_b"])


def _held(state: DataFrame, first: int, size: int, dim: int) -> Broadcast:
    """The vectors of ``size`` ids as one matrix; zeros where there is no such id."""
    found = state.where((F.col("id") >= first) & (F.col("id") < first + size)).select("id", "vec").toArrow().combine_chunks()
    matrix = np.zeros((size, dim))
    numbers = pc.list_flatten(found.column("vec")).to_numpy(zero_copy_only=False)
    matrix[found.column("id").to_numpy() - first] = numbers.reshape(-1, dim)
    return state.sparkSession.sparkContext.broadcast(matrix)


def _pair_gradients(part: DataFrame, a_vectors: Broadcast, a_first: int, b_vectors: Broadcast, b_first: int) -> DataFrame:
    """(id, g): the sum of the gradients of each word's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = a_vectors.value, b_vectors.value.copy()  # in large pages, which a value that was read is not
        room = np.empty((PARTNERS_AT_ONCE, y.shape[1]))
        for row in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
            ids, sizes, partners, times = pair_cells.unpacked(row)
            pos = times[0].astype(np.float64)
            both, partners, ends = pos + times[1], partners.astype(np.int64), np.cumsum(sizes)
            sums = np.zeros((len(ids), x.shape[1]))
            for at, (a, begin, end) in enumerate(zip((ids - a_first).tolist(), (ends - sizes).tolist(), ends.tolist())):
                for i in range(begin, end, PARTNERS_AT_ONCE):
                    some = slice(i, min(i + PARTNERS_AT_ONCE, end))
                    met = y.take(partners[some], axis=0, out=room[: some.stop - i], mode="clip")
                    p = met @ x[a]
                    np.exp(np.negative(np.maximum(p, -700.0, out=p), out=p), out=p)
                    p += 1.0
                    sums[at] += (pos[some] - both[some] / p) @ met
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1])
            yield pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["id", "g"])

    return part.select(*pair_cells.FIELDS).mapInArrow(run, "id bigint, g array<double>")


def _trained(state: DataFrame, part: DataFrame, dim: int, rate: float, held: int, top: int) -> DataFrame:
    """The next (id, vec, power), written, after one batch of pairs: every word moves along the sum of its pairs'
    gradients, the less the more it has moved before. A task holds the vectors of two ranges of ``held`` ids."""
    firsts = range(0, top + 1, held)
    vectors = [_held(state, first, min(held, top + 1 - first), dim) for first in firsts]
    cells = [
        _pair_gradients(part.where((F.col("at_a") == i) & (F.col("at_b") == j)), vectors[i], firsts[i], vectors[j], firsts[j])
        for i in range(len(firsts)) for j in range(len(firsts))]
    names = [f"_g{i}" for i in range(dim)]
    sums = reduce(DataFrame.unionByName, cells).groupBy("id").agg(*(F.sum(F.get("g", F.lit(i))).alias(g) for i, g in enumerate(names)))
    moved = state.join(sums.select("id", _as_array(names).alias("_g")), "id", "left")
    moved = moved.withColumn("power", F.col("power") + F.coalesce(dot(F.col("_g"), F.col("_g")), F.lit(0.0)))
    pace = F.when(F.col("power") > 0, F.lit(rate) / F.sqrt("power")).otherwise(F.lit(0.0))
    after = F.zip_with("vec", "_g", lambda x, g: x + F.col("_pace") * g)
    moved = moved.withColumn("_pace", pace).select("id", F.coalesce(after, "vec").alias("vec"), "power")
    written = materialise(moved, "word-vectors")
    for shared in vectors:
        shared.destroy()
    return written


def word_vectors(
    docs: DataFrame,
    vocab: DataFrame,
    *,
    id_col: str = "doc_id",
    tokens_col: str = "tokens",
    dim: int = 50,
    window: int = 5,
    epochs: int = 3,
    batches: int = 2,
    rate: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """(w, id, vec): skip-gram vectors of the words of ``vocab`` (w, id); written.

    One table of vectors serves both roles. The true pairs of words at most ``window`` places apart and as many pairs of
    ids drawn at random (id 0, any other word, among both) are told apart by the logistic function of the product of
    their vectors. Equal pairs are counted once and for all, so a step costs what there are of different pairs, however
    often they occur. Tasks count what they have made, and pass it on in arrays by cells of words, where counts meet. An
    epoch goes through them in ``batches`` steps; each reads the pairs of its batch and sums the gradients by word; pairs
    are never shuffled after they have been counted. Vectors, pairs and sums are tables. Vectors come to the tasks by ranges of as many ids as ``HOT_NUMBERS`` allows (but ``LEAST_HELD``): a task
    holds those of the words and of their partners in two such ranges, and with more ranges there are more tasks. A
    word's steps get shorter by the root of what its gradients have summed up to.
    """
    n = vocab.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    every = vocab.select("id").unionByName(docs.sparkSession.createDataFrame([(UNKNOWN_ID,)], "id bigint"))
    every = every.repartition(cores, "id")  # a written vocabulary is a few files, and numbers are drawn for every word
    state = materialise(_start(every, dim, seed), "word-vectors")
    top = max(state.agg(F.max("id")).first()[0], n)
    sequences = materialise(word_ids(docs, vocab, id_col=id_col, tokens_col=tokens_col), "sequences")
    pairs = skipgrams(sequences, id_col=id_col, window=window, runs=True)
    entries = 4 * (pairs.agg(F.sum("n")).first()[0] or 0)  # true and drawn, in both roles
    in_cells = min(top + 1, max(cores, -(-entries // CELL_ENTRIES)))
    cells = Cells(top + 1, in_cells, batches, max(HOT_NUMBERS // dim, LEAST_HELD))
    weights = pair_weights(training_pairs(pairs, n + 1, id_col=id_col, seed=seed, cells=cells), cells)
    for step in range(epochs * batches):
        part = weights.where(F.col("batch") == step % batches)
        state = _trained(state, part, dim, rate, cells.held, top)
    return materialise(vocab.select("w", "id").join(state.select("id", "vec"), "id"), "word-vectors")


def _as_array(names: list[str]) -> Column:
    return F.array(*[F.col(c) for c in names])


def _summed(
    docs: DataFrame, vectors: DataFrame, ids: list[str], tokens_col: str, dim: int, missed: bool = False
) -> DataFrame:
    """(ids.., n_known, vec): sums of the known words' vectors of each document within its task, a few words at a time; of
    several vectors of a word the first by id counts. With ``missed`` a column of that name lists the other words."""
    found = vectors.groupBy("w").agg(F.min_by("vec", "id").alias("vec")).toArrow().combine_chunks()
    matrix = found.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    shared = docs.sparkSession.sparkContext.broadcast((found.column("w").combine_chunks(), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix = shared.value
        for batch in (piece for whole in batches for piece in lookup.pieces(whole, len(ids))):
            lists = batch.column(len(ids))
            flat = lists.flatten()
            at = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            every = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            doc, met = every[at >= 0], at[at >= 0]
            sums = np.zeros((len(ends), dim))
            for i in range(0, len(met), WORDS_AT_ONCE):
                part = doc[i : i + WORDS_AT_ONCE]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                sums[part[first]] += np.add.reduceat(matrix[met[i : i + WORDS_AT_ONCE]], first, axis=0)
            offsets = pa.array(np.arange(len(ends) + 1, dtype=np.int32) * dim)
            columns = [
                *batch.columns[: len(ids)], pa.array(np.bincount(doc, minlength=len(ends)), pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))]
            if missed:
                left = np.r_[0, np.cumsum(np.bincount(every[at < 0], minlength=len(ends)))]
                columns.append(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.take(pa.array(np.flatnonzero(at < 0)))))
            yield pa.record_batch(columns, names=[*ids, "n_known", "vec", *(["missed"] if missed else [])])

    schema = StructType([*docs.select(*ids).schema]).add("n_known", LongType()).add("vec", ArrayType(DoubleType()))
    if missed:
        schema = schema.add("missed", ArrayType(StringType()))
    return docs.select(*ids, tokens_col).mapInArrow(run, schema)


def doc_vectors(
    docs: DataFrame,
    vectors: DataFrame,
    *,
    dim: int,
    id_col: str = "doc_id",
    tokens_col: str = "tokens",
    keep: tuple[str, ...] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """(id, keep.., n_known, vec): mean over the occurrences of known words, the zero vector where there are none.

    ``vectors``: a written table (w, id, vec) with ids by falling frequency. One of at most ``hot_rows`` words (as many as
    fit into ``HOT_NUMBERS``) is held by every task, and nothing is shuffled. Of a larger one the vectors of that many most
    frequent words are held and summed while a document is read; only rarer words travel, and only what a document has of
    them comes back to it. Each row has its own mean, whatever its id.
    """
    vectors = vectors.withColumn("vec", F.col("vec").cast("array<double>"))
    head, tail = lookup.by_rank(vectors, "w", "id", hot_rows or HOT_NUMBERS // dim)
    ids = [id_col, *keep]
    mean = F.transform("vec", lambda x: F.when(F.col("n_known") > 0, x / F.col("n_known")).otherwise(F.lit(0.0)))
    if tail is None:
        return _summed(docs, head, ids, tokens_col, dim).withColumn("vec", mean)
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    first = materialise(_summed(rows, head, ["_row", *ids], tokens_col, dim, missed=True), "head-sums")
    times = first.select("_row", F.explode("missed").alias("w")).groupBy("_row", "w").agg(F.count("*").alias("_times"))
    met = times.join(tail.select("w", F.col("vec").alias("_tail")), "w")
    sums = [f"_s{i}" for i in range(dim)]
    found = met.groupBy("_row").agg(
        F.sum("_times").alias("_n"), *[F.sum(F.col("_times") * F.get("_tail", F.lit(i))).alias(s) for i, s in enumerate(sums)])
    both = first.join(found.select("_row", "_n", _as_array(sums).alias("_rest")), "_row", "left")
    added = F.coalesce(F.zip_with("vec", "_rest", lambda x, y: x + y), "vec")
    totals = both.select(*ids, (F.col("n_known") + F.coalesce("_n", F.lit(0))).alias("n_known"), added.alias("vec"))
    return totals.withColumn("vec", mean)


def prototypes(vectors: DataFrame, *, dim: int, label_col: str = "label", vec_col: str = "vec") -> DataFrame:
    """(label, vec): element-wise mean of the vectors of each class; all-zero vectors do not count."""
    nonzero = vectors.where(F.exists(vec_col, lambda x: x != 0))
    means = nonzero.groupBy(label_col).agg(
        *[F.avg(F.get(vec_col, F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(dim)]
    )
    return means.select(F.col(label_col).alias("label"), _as_array([f"_s{i}" for i in range(dim)]).alias("vec"))


def nearest(vectors: DataFrame, protos: DataFrame, *, dim: int, vec_col: str = "vec") -> DataFrame:
    """Adds ``sim_fake``, ``sim_real`` and the verdict of the nearer prototype; a tie is real, a missing prototype is the
    zero vector. The at most two prototypes enter as literals, so the vectors are read once and not shuffled."""
    found = {r["label"]: r["vec"] for r in protos.where(F.col("label").isin("fake", "real")).collect()}
    known = {c: F.array(*[F.lit(x) for x in found.get(c, [0.0] * dim)]) for c in ("fake", "real")}
    vec = F.col(vec_col).cast("array<double>")
    scored = vectors.select("*", *[cosine(vec, known[c]).alias(f"sim_{c}") for c in known])
    return scored.withColumn("verdict", argmax_verdict(F.col("sim_fake"), F.col("sim_real")))
