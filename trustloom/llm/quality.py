"""Document quality by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.language import fold
from trustloom.llm.rows import column, packed, table
from trustloom.llm.words import LOWER_WORDS, WHITE_SPACE, mix, small_batches, split_words

SHAPES = 2048
WORDS = 2048
FEATURES = SHAPES + WORDS
# Words count half beside the shape.
WORD_SHARE = 0.25
RANK = 48
BLOCK = 512
# What kind of letter each byte is: small, large, digit, blank, line end, beyond ASCII; other signs stand for themselves.
_SHAPE = bytes(
    ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b
    for b in range(256))


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` numbers per text, as square roots of shares: how often each hashed run of three and five bytes
    of its shape occurs, how often a word repeats the one before it, and how often each hashed word occurs, in whatever
    case. Runs of one kind of letter count as one, so the shape tells capitals, signs, digits and tables; the words tell
    what the text says."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    words, terms = split_words(texts, WHITE_SPACE), split_words(texts, LOWER_WORDS)
    bins = (terms.print % np.uint64(WORDS)).astype(np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        shape = np.frombuffer(text.encode().translate(_SHAPE), dtype=np.uint8)
        shape = shape[np.r_[True, shape[1:] != shape[:-1]]].astype(np.uint64)
        found = []
        for size in (3, 5):
            if len(shape) >= size:
                gram = np.zeros(len(shape) - size + 1, dtype=np.uint64)
                for j in range(size):
                    gram = gram << np.uint64(8) | shape[j : len(shape) - size + 1 + j]
                found.append(mix(gram + np.uint64(size << 48)) % np.uint64(SHAPES - 2))
        if found:
            counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=SHAPES)
            out[i, :SHAPES] = counts / counts.sum()
        prints = words.print[words.first[i] : words.first[i + 1]]
        if len(prints) > 1:
            again = float((prints[1:] == prints[:-1]).mean())
            out[i, SHAPES - 2 : SHAPES] = again, 1.0 - again
        said = bins[terms.first[i] : terms.first[i + 1]]
        if len(said):
            out[i, SHAPES:] = np.bincount(said, minlength=WORDS) * (WORD_SHARE / len(said))
    return np.sqrt(out)


class Model:
    """The projection into the latent space, and the labelled documents there."""

    def __init__(self, x: np.ndarray, y: np.ndarray, neighbours: int, power: float, seed: int = 5):
        self.neighbours, self.power = neighbours, power
        self.prior = float(y.mean()) if len(y) else 0.5
        self.labels = y.astype(np.float32)
        # Terms that are in every document say little.
        self.weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        self.basis = np.zeros((x.shape[1], 0), dtype=np.float32)
        if len(x):
            self.basis = _right_vectors(x * self.weight, min(RANK, *x.shape), seed)
        self.vectors = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors; a document without any feature stays zero."""
        z = (x * self.weight) @ self.basis
        length = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, length, out=np.zeros_like(z), where=length > 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The weighted vote for label 1 of the nearest labelled documents by cosine. Weights are cosines to a power, so
        that the nearest count most. Documents like none of them get the labelled documents' own share."""
        out = np.full(len(x), self.prior)
        k = min(self.neighbours, len(self.labels))
        if k == 0:
            return out
        z = self.project(x)
        for lo in range(0, len(z), BLOCK):
            cosine = z[lo : lo + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0.0, 1.0).astype(np.float64) ** self.power
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[lo : lo + BLOCK] = np.divide(vote, total, out=out[lo : lo + BLOCK].copy(), where=total > 1e-9)
        return np.clip(out, 0.0, 1.0)


def _right_vectors(x: np.ndarray, rank: int, seed: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from random directions."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :rank], dtype=np.float32)


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality",
    per_label: int = 1_500, neighbours: int = 15, power: float = 4.0,
) -> Model:
    """Learn from the documents that ``labels`` marks 0 or 1: at most about ``per_label`` of each, chosen by a hash of the
    id (a bounded sample of labelled rows). Equal numbers of both keep the rarer label from being outvoted. The sample's
    ids, a few thousand, are broadcast to find its documents; only their features (4,096 numbers each) come back, and
    the latent space is fitted on them. Null labels and ids are no label; an id with both labels is none either.
    Of several texts under one id one is learnt from."""
    marks = packed(labels).select(column(id, "row").cast("long").alias("id"), column(label, "row").cast("int").alias("y"))
    marks = marks.where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(
        F.min("y").alias("y"), F.max("y").alias("other")).where(F.col("y") == F.col("other")).select("id", "y")
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(1_000_000)) / 1_000_000.0
    limit = F.when(F.col("y") == 1, min(1.0, per_label / sizes.get(1, 1))).otherwise(min(1.0, per_label / sizes.get(0, 1)))
    sample = marks.where(draw < limit)
    rows = packed(docs).select(column(id, "row").cast("long").alias("id"), column(text, "row").alias("text"))
    rows = rows.join(F.broadcast(sample), "id").where(F.length("text") > 0)
    # Of several texts under one id the one with the smallest fingerprint, on every run.
    one = F.min(F.struct(F.xxhash64("text").alias("print"), "y", "text")).alias("row")
    rows = rows.groupBy("id").agg(one).select("id", "row.y", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = features(batch.column("text"))
            yield pa.record_batch(
                [batch.column("id"), batch.column("y"), pa.array([row.tobytes() for row in x], pa.binary())],
                names=["id", "y", "x"])

    found = rows.mapInArrow(run, "id bigint, y int, x binary").orderBy("id").collect()
    x = np.frombuffer(b"".join(r.x for r in found), dtype=np.float32).reshape(-1, FEATURES)
    return Model(x, np.array([r.y for r in found]), neighbours, power)


def score_quality(
    docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", threshold: float = 0.3,
) -> DataFrame:
    """``id``, ``score`` (0 to 1, higher where label 1 is likelier) and ``predicted`` (1 if the score is at least
    ``threshold``) for each row, from the whole text alone. The labelled vectors are broadcast (their number is bounded
    by the fit) and every document is compared with all of them, a block of documents at a time. A null or empty text
    has no neighbours and gets the labelled documents' share of label 1. Repeated rows each give a row."""
    rows = packed(docs).select(column(id, "row").cast("long").alias("id"), column(text, "row").alias("text"))
    run = _scored(docs, model, lambda batch: [batch.column("id")], ["id"])
    return rows.mapInArrow(run, "id bigint, score double").select(
        F.col("id").alias(id), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, whole, without leaving their tasks."""
    rows = packed(docs).withColumn("text", column(text, "row"))
    run = _scored(docs, model, lambda batch: [batch.column("row")], ["row"])
    scored = rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))
    return scored.where(F.col("score") >= threshold).select(*(column(c, "row").alias(c) for c in docs.columns))


def _scored(docs: DataFrame, model: Model, kept, names: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            score = shared.value.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*kept(batch), pa.array(score, pa.float64())], names=[*names, "score"])

    return run


def fit_on(spark, docs: DataFrame, sf_dir: str) -> Model:
    """Fitted on the labels of the tables at ``sf_dir``, without those of every fifth document, which are held out."""
    labels = table(spark, sf_dir, "labels")
    return fit_quality(docs, labels.where(fold("doc_id", 5) != 0))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_on(spark, docs, sf_dir))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
