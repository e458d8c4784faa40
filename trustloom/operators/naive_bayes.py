"""Two-class naive Bayes as joins and aggregates; the model is a table, not a map."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions.scalar import argmax_verdict, two_class_probability
from trustloom.functions.text import occurrences
from trustloom.operators import lookup
from trustloom.session import materialise

CLASSES = ("fake", "real")
MINUS_INF = float("-inf")


@dataclass
class NbTotals:
    docs_fake: int
    docs_real: int
    vocab: int
    tokens_fake: float
    tokens_real: float
    smoothing: float

    def prior(self, c: str) -> float:
        """Log share of the class; -inf for a class without documents."""
        docs = {"fake": self.docs_fake, "real": self.docs_real}[c]
        return math.log(docs / (self.docs_fake + self.docs_real)) if docs else MINUS_INF

    def denominator(self, c: str) -> float:
        return {"fake": self.tokens_fake, "real": self.tokens_real}[c] + self.smoothing * self.vocab

    def unknown(self, c: str) -> float:
        """Log likelihood of a word the model does not have; 0 for a model without words, which decides nothing."""
        if not self.denominator(c):
            return 0.0
        return math.log(self.smoothing / self.denominator(c)) if self.smoothing else MINUS_INF


@dataclass
class NbModel:
    """``terms``: (w, n_fake, n_real), a written table with one row per word of either class."""

    terms: DataFrame
    totals: NbTotals

    def log_likelihoods(self) -> DataFrame:
        """(w, n, ll_fake, ll_real)"""

        def log_likelihood(c: str) -> Column:
            weight = F.col(f"n_{c}") + F.lit(float(self.totals.smoothing))
            share = weight / F.lit(self.totals.denominator(c) or 1.0)
            return F.when(share > 0, F.log(share)).otherwise(F.lit(MINUS_INF)).alias(f"ll_{c}")

        return self.terms.select(
            "w", (F.col("n_fake") + F.col("n_real")).alias("n"), *[log_likelihood(c) for c in CLASSES]
        )

    def save(self, path: str) -> None:
        """Write the model as two tables, to be trained once and scored many times."""
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        totals = self.terms.sparkSession.createDataFrame([asdict(self.totals)])
        totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NbModel:
        totals = NbTotals(**spark.read.parquet(f"{path}/totals").first().asDict())
        return NbModel(spark.read.parquet(f"{path}/terms"), totals)


def class_counts(docs: DataFrame, label_col: str = "label") -> tuple[int, int]:
    """Documents per class, those without words included; a label other than fake and real is an error."""
    label = F.col(label_col)
    n, fake, real = docs.agg(F.count("*"), F.count_if(label == "fake"), F.count_if(label == "real")).first()
    if n != fake + real:
        raise ValueError(f"{n - fake - real} documents have a label other than fake and real")
    return fake, real


def term_counts(docs: DataFrame, label_col: str = "label", tokens_col: str = "tokens") -> DataFrame:
    """(w, n_fake, n_real) over all occurrences. Counted before the shuffle, so a frequent word is one row per task."""
    label = F.col(label_col)
    return (
        occurrences(docs, tokens_col, label_col)
        .groupBy("w")
        .agg(*[F.count_if(label == c).alias(f"n_{c}") for c in CLASSES])
    )


def _fitted(terms: DataFrame, docs: tuple[int, int], smoothing: float) -> NbModel:
    written = materialise(terms, "nb-terms")
    vocab, fake, real = written.agg(F.count("*"), F.sum("n_fake"), F.sum("n_real")).first()
    return NbModel(written, NbTotals(*docs, vocab, float(fake or 0), float(real or 0), float(smoothing)))


def nb_fit(
    docs: DataFrame,
    *,
    label_col: str = "label",
    tokens_col: str = "tokens",
    smoothing: float = 1.0,
    class_docs: DataFrame | None = None,
) -> NbModel:
    """Count words and documents per class. ``class_docs`` are the same documents in a form that is cheaper to count."""
    docs_per_class = class_counts(docs if class_docs is None else class_docs, label_col)
    return _fitted(term_counts(docs, label_col, tokens_col), docs_per_class, smoothing)


def nb_fit_weighted(
    weights: DataFrame, docs: DataFrame, *, label_col: str = "label", smoothing: float = 0.1
) -> NbModel:
    """Multinomial naive Bayes on weighted words: ``weights`` has (label, term, weight), ``docs`` one row per document."""
    label = F.col(label_col)
    terms = weights.groupBy(F.col("term").alias("w")).agg(
        *[F.sum(F.when(label == c, F.col("weight")).otherwise(F.lit(0.0))).alias(f"n_{c}") for c in CLASSES]
    )
    return _fitted(terms, class_counts(docs, label_col), smoothing)


def _verdicts(sums: DataFrame, totals: NbTotals, tie: str) -> DataFrame:
    others = [c for c in sums.columns if c not in ("s_fake", "s_real")]
    scored = sums.select(*others, *[(F.col(f"s_{c}") + F.lit(totals.prior(c))).alias(f"s_{c}") for c in CLASSES])
    fake, real = F.col("s_fake"), F.col("s_real")
    verdict = argmax_verdict(fake, real) if tie == "real" else F.when(fake >= real, "fake").otherwise("real")
    return scored.select("*", two_class_probability(fake, real).alias("p_fake"), verdict.alias("verdict"))


def nb_score(
    docs: DataFrame,
    model: NbModel,
    *,
    id_col: str = "doc_id",
    tokens_col: str = "tokens",
    keep: tuple[str, ...] = (),
    unknown: str = "count",
    hot_rows: int = lookup.HOT_ROWS,
) -> DataFrame:
    """(id, keep.., s_fake, s_real, p_fake, verdict) for every document, also those without words.

    ``unknown='count'`` gives a word outside the model its smoothed value, ``'skip'`` leaves it out. ``keep`` names
    columns fixed by the id that are carried along. Words of the broadcast head of the model are added up inside the
    task that reads the document, so one row per document is shuffled; only words outside the head travel themselves.
    """
    if unknown not in ("count", "skip"):
        raise ValueError("unknown must be count or skip")
    ids = [id_col, *keep]
    absent = {c: F.lit(model.totals.unknown(c) if unknown == "count" else 0.0) for c in CLASSES}
    head, tail = lookup.by_count(model.log_likelihoods(), "w", "n", hot_rows)
    words = docs.select(*ids, F.explode_outer(tokens_col).alias("w"))
    if tail is None:
        met = words.join(F.broadcast(head.drop("n")), "w", "left")
        values = {
            c: F.when(F.col("w").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.col(f"ll_{c}"), absent[c]))
            for c in CLASSES
        }
    else:
        met = lookup.meet_head(words, head.drop("n"), "w").groupBy(*ids, "_missed").agg(
            *[F.sum(f"ll_{c}").alias(f"head_{c}") for c in CLASSES], F.count("*").alias("times")
        )
        met = lookup.meet_tail(met, tail.drop("n"), "w", F.col(id_col))
        values = {
            c: F.when(F.col("_missed").isNull(), F.coalesce(F.col(f"head_{c}"), F.lit(0.0))).otherwise(
                F.col("times") * F.coalesce(F.col(f"ll_{c}"), absent[c])
            )
            for c in CLASSES
        }
    sums = met.groupBy(*ids).agg(*[F.sum(values[c]).alias(f"s_{c}") for c in CLASSES])
    return _verdicts(sums, model.totals, "real")


def nb_score_weighted(
    weights: DataFrame, docs: DataFrame, model: NbModel, *, id_col: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """As ``nb_score`` on (id, keep.., term, weight) rows whose terms all belong to the model. A tie is fake here."""
    ids = [id_col, *keep]
    likelihoods = model.log_likelihoods().select(F.col("w").alias("term"), "ll_fake", "ll_real")
    sums = (
        weights.join(lookup.bounded(likelihoods, model.totals.vocab), "term")
        .groupBy(*ids)
        .agg(*[F.sum(F.col("weight") * F.col(f"ll_{c}")).alias(f"s_{c}") for c in CLASSES])
    )
    every = docs.select(*ids).join(sums, ids, "left").na.fill(0.0, [f"s_{c}" for c in CLASSES])
    return _verdicts(every, model.totals, "fake")
