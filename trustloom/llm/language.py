"""Which languages a document is written in, as a mixture found by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.rows import column, packed, table
from trustloom.llm.words import mix, small_batches

GRAM_BITS = 16
MODEL_BITS = 24  # a model has at most 2^24 numbers; the more languages, the fewer cells for n-grams
GRAM_SIZES = (2, 4)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# Bytes of a word: ASCII letters and everything beyond ASCII. All others become one blank.
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_counts(text: str, bits: int = GRAM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte n-grams of the text's lower-cased words (with a blank at both ends) and how often they occur."""
    data = b" " + b" ".join(text.lower().encode().translate(_BLANKED).split()) + b" "
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    found = []
    for size in GRAM_SIZES:
        if len(codes) >= size:
            gram = np.zeros(len(codes) - size + 1, dtype=np.uint64)
            for j in range(size):
                gram = gram << np.uint64(8) | codes[j : len(codes) - size + 1 + j]
            found.append(mix(gram + np.uint64(size << 40)) >> np.uint64(64 - bits))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << bits)
    grams = np.flatnonzero(counts)
    return grams, counts[grams].astype(float)


def mixture(likelihood: np.ndarray, counts: np.ndarray, rounds: int = 50, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """The proportions of the columns of ``likelihood`` (n-grams x languages) that make the counts most likely, and the
    log-likelihood, by expectation-maximisation from equal shares."""
    share = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        parts = likelihood * share
        weight = counts / parts.sum(axis=1)
        new = weight @ parts / total
        moved = np.abs(new - share).max()
        share = new
        if moved < close:
            break
    return share, float(counts @ np.log((likelihood * share).sum(axis=1)))


class Model:
    """Smoothed n-gram probabilities of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        self.bits = len(counts).bit_length() - 1
        self.log = np.log((counts + smoothing) / (counts + smoothing).sum(axis=0))

    def languages_of(self, text: str | None, penalty: float) -> tuple[str, float, dict[str, float]]:
        """The main language, its share, and the shares of all languages in the text.

        Languages join the set one by one, each time the one that raises the likelihood of the mixture most, as long as
        it gains more than ``penalty`` times the logarithm of the number of n-grams. One n-gram overlaps the next, so
        each counts for half.
        """
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0, {}
        grams, counts = gram_counts(text, self.bits)
        if not len(grams):
            return UNKNOWN, 0.0, {}
        counts = counts / len(GRAM_SIZES)
        log = self.log[grams]
        alone = counts @ log
        likelihood = np.exp(log - log.max(axis=1, keepdims=True))
        best, cost = [int(np.argmax(alone))], penalty * np.log(max(counts.sum(), 2.0))
        share, fit = mixture(likelihood[:, best], counts)
        while len(best) < len(self.languages):
            # An upper bound on what any further language can add spares most documents the search.
            if counts @ np.log(likelihood.max(axis=1)) - fit <= cost:
                break
            tried = [(*mixture(likelihood[:, [*best, j]], counts), j) for j in range(len(self.languages)) if j not in best]
            new_share, new_fit, j = max(tried, key=lambda t: t[1])
            if new_fit - fit <= cost:
                break
            best, share, fit = [*best, j], new_share, new_fit
        top = int(np.argmax(share))
        # How sure: the share of the main language, times how clearly it beats the others alone where it stands alone.
        shares = {self.languages[j]: float(p) for j, p in zip(best, share)}
        return self.languages[best[top]], float(min(max(share[top], 0.0), 1.0)), shares


def fit_languages(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = 5_000) -> Model:
    """Learn from the rows of ``docs`` with a language: at most about ``per_language`` different texts of each, chosen by a
    hash of the text (a bounded sample, so that the work of fitting does not grow, whatever rows repeat). Counts are summed
    by Spark; the model is a table of 2^16 numbers per language, or of 2^24 in all where there are more than 256. A
    language without any n-gram is kept but never likely; without labelled rows the model knows no language and says
    ``und`` to everything."""
    rows = packed(docs).select(column(lang, "row").alias("lang"), column(text, "row").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit((1 << MODEL_BITS - 8) + 1).collect()
    languages = [r.lang for r in sizes]
    if not languages:
        return Model([], np.zeros((1 << GRAM_BITS, 0)))
    bits = min(GRAM_BITS, MODEL_BITS - (len(languages) - 1).bit_length())
    if bits < 8:
        raise ValueError(f"a column of more than {1 << MODEL_BITS - 8} values does not name languages")
    known = docs.sparkSession.createDataFrame(
        [(r.lang, min(1.0, per_language / r.n)) for r in sizes], "lang string, share double")
    rows = rows.join(F.broadcast(known), "lang").withColumn("print", F.xxhash64("text"))
    draw = F.pmod(F.xxhash64(F.lit(29), "print"), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.where(draw < F.col("share")).dropDuplicates(["lang", "print"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, "text"):
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                grams, n = gram_counts(body, bits)
                sums.setdefault(name, np.zeros(1 << bits))[grams] += n
        for name, values in sums.items():
            grams = np.flatnonzero(values)
            yield pa.record_batch(
                [pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(values[grams])],
                names=["lang", "gram", "n"])

    table_rows = sample.mapInArrow(count, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # At most 2^24 numbers, whatever the input.
    found = table_rows.toPandas()
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((1 << bits, len(languages)))
    counts[found["gram"].to_numpy(dtype=np.int64), found["lang"].map(place).to_numpy(dtype=np.int64)] = found["n"]
    return Model(languages, counts)


def identify_languages(
    docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", penalty: float = 2.0,
) -> DataFrame:
    """Per row: ``id``, ``lang_pred`` (the language with the largest share), ``score`` (that share, 0 to 1) and ``shares``
    (language to share, for each language of the set). A null text, or one without a letter, is ``und`` with score 0.
    Nothing but the text is looked at; the whole text counts. Each row gives one row, also repeated ones."""
    rows = packed(docs).select(column(id, "row").cast("long").alias("id"), column(text, "row").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [shared.value.languages_of(t, penalty) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([
                batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                names=["id", "lang_pred", "score", "shares"])

    found = rows.mapInArrow(run, "id bigint, lang_pred string, score double, shares map<string,double>")
    return found.select(F.col("id").alias(id), "lang_pred", "score", "shares")


def fold(id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % folds if isinstance(id, str) else F.crc32(id) % folds


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = fit_languages(docs.where(~held_out))
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
