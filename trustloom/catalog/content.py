"""Queries on words, naive Bayes and TF-IDF."""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.catalog.tables import (
    LABELLED,
    PREFIX_FOLD,
    STRATIFIED_FOLD,
    documents,
    labelled,
    metrics_sql,
    nb_ctes,
    nb_score_ctes,
    table,
    tokens_sql,
    with_tokens,
)
from trustloom.functions.constants import NOUN_ENDINGS
from trustloom.functions.scalar import flag_or_marker
from trustloom.functions.text import occurrences, tokeniser
from trustloom.operators.lemmas import lemma_table, lemmatise
from trustloom.operators.linear import logistic_fit, logistic_score, momentum_limits
from trustloom.operators.metrics import evaluate
from trustloom.operators.naive_bayes import nb_fit, nb_fit_weighted, nb_score, nb_score_weighted, term_counts
from trustloom.operators.split import split_prefix, split_stratified
from trustloom.operators.tfidf import document_frequency, tfidf_fit, tfidf_transform
from trustloom.session import materialise


LOGISTIC_STEPS = 25


def _clean_tokens(cleaner):
    def query(spark, sf_dir):
        docs = with_tokens(documents(spark, sf_dir), cleaner)
        return docs.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))

    return query


def _term_counts(cleaner):
    def query(spark, sf_dir):
        return term_counts(with_tokens(labelled(spark, sf_dir), cleaner))

    return query


def vocab_stats(spark, sf_dir):
    """Totals of the model, as a row over its term table."""
    model = nb_fit(with_tokens(labelled(spark, sf_dir), "a"))
    t = model.totals
    return model.terms.agg(
        F.lit(t.docs_fake).cast("bigint").alias("docs_fake"),
        F.lit(t.docs_real).cast("bigint").alias("docs_real"),
        F.count("*").alias("vocab"),
        F.sum("n_fake").alias("tokens_fake"),
        F.sum("n_real").alias("tokens_real"),
        *[F.round(F.lit(t.prior(c)), 6).alias(f"prior_{c}") for c in ("fake", "real")],
        *[F.round(F.lit(t.unknown(c)), 6).alias(f"unk_{c}") for c in ("fake", "real")],
    )


def nb_terms(spark, sf_dir):
    terms = nb_fit(with_tokens(labelled(spark, sf_dir), "a")).log_likelihoods()
    return terms.select("w", F.round("ll_fake", 6).alias("ll_fake"), F.round("ll_real", 6).alias("ll_real"))


def prefix_fold(spark, sf_dir):
    return split_prefix(labelled(spark, sf_dir), id_col="doc_id")


def stratified_fold(spark, sf_dir):
    return split_stratified(labelled(spark, sf_dir), id_col="doc_id")


def prefix_split(spark, sf_dir):
    return prefix_fold(spark, sf_dir).select("doc_id", "label", "fold")


def stratified_split(spark, sf_dir):
    return stratified_fold(spark, sf_dir).select("doc_id", "label", "fold")


def split_totals(spark, sf_dir):
    return stratified_fold(spark, sf_dir).groupBy("fold", "label").agg(F.count("*").alias("n_docs"))


def sides(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(folded.where(F.col("fold") == side).drop("fold") for side in ("train", "test"))


def held_out_a(folded):
    """Cleaner a, unknown words counted."""
    train, test = sides(with_tokens(folded, "a"))
    return nb_score(test, nb_fit(train), keep=("label",))


def nb_scores(spark, sf_dir):
    scored = held_out_a(prefix_fold(spark, sf_dir))
    return scored.select(
        "doc_id", "label", F.round("s_fake", 4).alias("s_fake"), F.round("s_real", 4).alias("s_real"), "verdict"
    )


def nb_probabilities(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = nb_fit(with_tokens(labelled(spark, sf_dir), "b"))
    scored = nb_score(with_tokens(docs, "b"), model, unknown="skip")
    return scored.select("doc_id", F.round("p_fake", 6).alias("p_fake"))


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    for c in ("accuracy", "precision", "recall", "f1"):
        metrics = metrics.withColumn(c, F.round(c, 6))
    return metrics


def nb_metrics(spark, sf_dir):
    return rounded_metrics(evaluate(held_out_a(prefix_fold(spark, sf_dir))))


def prediction_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("score"))
    return docs.join(labels, "doc_id", "left").select("doc_id", flag_or_marker(F.col("score")).alias("prediction"))


def _lexicon(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select("text")
    return occurrences(texts, tokeniser("c")(F.col("text"))).distinct()


def _lemmas(spark, sf_dir, docs):
    words = occurrences(docs, "tokens").distinct()
    return lemma_table(words, _lexicon(spark, sf_dir))


def lemmas(spark, sf_dir):
    return _lemmas(spark, sf_dir, with_tokens(documents(spark, sf_dir), "c"))


def lemma_rounds(spark, sf_dir):
    """The words of the documents, those of the lexicon with an ending twice over, and irregular forms of them."""
    lexicon = materialise(_lexicon(spark, sf_dir), "lexicon")
    irregular = lexicon.select(F.concat("w", F.lit("ren")).alias("w"), F.col("w").alias("lemma"))
    words = occurrences(with_tokens(documents(spark, sf_dir), "c"), "tokens")
    words = words.unionByName(lexicon.select(F.concat("w", F.lit("ss")).alias("w"))).unionByName(irregular.select("w"))
    return lemma_table(words.distinct(), lexicon, irregular)


@F.arrow_udf(T.ArrayType(T.StringType()))
def long_words(texts: pa.Array) -> pa.Array:
    """A tokeniser as a caller may bring one along: words of four letters or more."""
    return pa.array([re.findall("[a-z]{4,}", (t or "").lower()) for t in texts.to_pylist()], pa.list_(pa.string()))


def caller_tokeniser_counts(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    return term_counts(docs.select("label", tokeniser(long_words)(F.col("text")).alias("tokens")))


def lemmatised_tokens(spark, sf_dir):
    docs = with_tokens(documents(spark, sf_dir), "c")
    based = lemmatise(docs, _lemmas(spark, sf_dir, docs))
    return based.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def base_sides(spark, sf_dir):
    """Cleaner c with lemmas, stratified 75/25: texts are cleaned once, for the lemmas and for the written tokens, however
    many models use them."""
    folded = with_tokens(stratified_fold(spark, sf_dir), "c").select("doc_id", "label", "fold", "tokens")
    folded = materialise(folded, "clean-tokens")
    based = lemmatise(folded, _lemmas(spark, sf_dir, folded), keep=("label", "fold"))
    return sides(materialise(based, "base-tokens"))


def held_out_lemmas(train, test):
    """Naive Bayes on base forms, unknown words counted."""
    return nb_score(test, nb_fit(train), keep=("label",))


def nb_lemma_verdicts(spark, sf_dir):
    return held_out_lemmas(*base_sides(spark, sf_dir)).select("doc_id", "label", "verdict")


def doc_freq(spark, sf_dir):
    train, _ = base_sides(spark, sf_dir)
    return document_frequency(train, train.count())


def tfidf_weights(spark, sf_dir):
    train, test = base_sides(spark, sf_dir)
    weights = tfidf_transform(test, tfidf_fit(train))
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def held_out_tfidf_nb(train, test):
    model = tfidf_fit(train)
    fitted = nb_fit_weighted(tfidf_transform(train, model, keep=("label",)), train)
    return nb_score_weighted(tfidf_transform(test, model, keep=("label",)), test, fitted, keep=("label",))


def tfidf_nb_scores(spark, sf_dir):
    scored = held_out_tfidf_nb(*base_sides(spark, sf_dir))
    return scored.select(
        "doc_id", "label", F.round("s_fake", 4).alias("s_fake"), F.round("s_real", 4).alias("s_real"), "verdict"
    )


def tfidf_nb_metrics(spark, sf_dir):
    return rounded_metrics(evaluate(held_out_tfidf_nb(*base_sides(spark, sf_dir))))


def held_out_logistic(train, test):
    """A fixed number of steps, so that the SQL can take the same ones."""
    model = tfidf_fit(train)
    fitted = logistic_fit(tfidf_transform(train, model, keep=("label",)), train, max_steps=LOGISTIC_STEPS, tol=0.0)
    return logistic_score(tfidf_transform(test, model, keep=("label",)), test, fitted, keep=("label",))


def logistic_scores(spark, sf_dir):
    scored = held_out_logistic(*base_sides(spark, sf_dir))
    return scored.select("doc_id", "label", F.round("p_fake", 6).alias("p_fake"), "verdict")


QUERIES = {
    "clean_tokens_a": _clean_tokens("a"),
    "clean_tokens_b": _clean_tokens("b"),
    "clean_tokens_c": _clean_tokens("c"),
    "term_counts_a": _term_counts("a"),
    "term_counts_b": _term_counts("b"),
    "term_counts_c": _term_counts("c"),
    "vocab_stats": vocab_stats,
    "nb_terms": nb_terms,
    "prefix_split": prefix_split,
    "stratified_split": stratified_split,
    "split_totals": split_totals,
    "nb_scores": nb_scores,
    "nb_probabilities": nb_probabilities,
    "nb_metrics": nb_metrics,
    "prediction_flags": prediction_flags,
    "lemmas": lemmas,
    "lemma_rounds": lemma_rounds,
    "caller_tokeniser_counts": caller_tokeniser_counts,
    "lemmatised_tokens": lemmatised_tokens,
    "nb_lemma_verdicts": nb_lemma_verdicts,
    "doc_freq": doc_freq,
    "tfidf_weights": tfidf_weights,
    "tfidf_nb_scores": tfidf_nb_scores,
    "tfidf_nb_metrics": tfidf_nb_metrics,
    "logistic_scores": logistic_scores,
}


# --- SQL -------------------------------------------------------------------------------------------------------------


LEXICON = f"lexicon AS (SELECT DISTINCT unnest({tokens_sql('c')}) AS w FROM conversations)"
ROUNDS = 6


def lemma_ctes(words: str, more: str = "") -> str:
    """CTEs up to ``lemmas(w, lemma)`` for ``words(w)``: ``ROUNDS`` rounds of the rules. ``more``: further candidates."""
    ctes = [f"forms0 AS (SELECT w, w AS lemma, '' AS place FROM {words})"]
    for k in range(1, ROUNDS + 1):
        rules = "\n  UNION ALL ".join(
            f"SELECT w, left(lemma, length(lemma) - {len(old)}) || '{new}' AS lemma, place || '{i}' AS place "
            f"FROM forms{k - 1} WHERE lemma LIKE '%{old}'"
            for i, (old, new) in enumerate(NOUN_ENDINGS, start=1)
        )
        ctes.append(f"forms{k} AS MATERIALIZED (\n  {rules})")
    rounds = "\n  UNION ALL ".join(f"SELECT w, lemma, place, {max(k, 1)} AS round FROM forms{k}" for k in range(ROUNDS + 1))
    every = ",\n".join(ctes)
    return f"""{LEXICON},
{every},
candidates AS (
  {rounds}{more}),
lemmas AS (
  SELECT w, lemma FROM candidates WHERE lemma IN (SELECT w FROM lexicon)
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY round, length(lemma), place) = 1 AND lemma <> w)"""


def lemmatised_ctes(docs: str) -> str:
    """CTEs up to ``based(doc_id, label, tokens)`` from ``docs(doc_id, text, label)``."""
    return f"""placed AS MATERIALIZED (
  SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos
  FROM (SELECT doc_id, {tokens_sql('c')} AS toks FROM {docs})),
all_words AS (SELECT DISTINCT w FROM placed),
{lemma_ctes('all_words')},
regrouped AS (
  SELECT p.doc_id, list(coalesce(l.lemma, p.w) ORDER BY p.pos) AS tokens
  FROM placed p LEFT JOIN lemmas l USING (w) GROUP BY p.doc_id)"""


def grams(words: str) -> str:
    """The words and their adjacent pairs."""
    return (
        f"list_concat({words}, list_transform(range(1, greatest(len({words}), 1)), "
        f"lambda i: {words}[i] || ' ' || {words}[i + 1]))"
    )


BASED = f"""{lemmatised_ctes('labelled')},
based AS MATERIALIZED (
  SELECT f.doc_id, f.label, f.fold, coalesce(r.tokens, []) AS tokens
  FROM folded f LEFT JOIN regrouped r ON f.doc_id = r.doc_id)"""

TFIDF = f"""{BASED},
token_lists AS (SELECT doc_id, label, fold, tokens AS toks FROM based),
gram_rows AS MATERIALIZED (SELECT doc_id, label, fold, unnest({grams('toks')}) AS term FROM token_lists),
train_docs AS (SELECT doc_id, label FROM folded WHERE fold = 'train'),
test_docs AS (SELECT doc_id, label FROM folded WHERE fold = 'test'),
doc_freq AS (
  SELECT term, count(DISTINCT doc_id) AS df FROM gram_rows WHERE fold = 'train' GROUP BY term
  HAVING count(DISTINCT doc_id) >= 3
    AND count(DISTINCT doc_id) <= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM train_docs)),
raw AS (
  SELECT g.doc_id, g.label, g.fold, g.term,
    count(*) * (ln((1 + (SELECT count(*) FROM train_docs)) / (1 + any_value(f.df))) + 1) AS raw
  FROM gram_rows g JOIN doc_freq f USING (term) GROUP BY g.doc_id, g.label, g.fold, g.term),
weights AS (
  SELECT doc_id, label, fold, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""

TFIDF_NB = f"""WITH {LABELLED},
{STRATIFIED_FOLD},
{TFIDF},
class_terms AS (
  SELECT term, coalesce(sum(weight) FILTER (label = 'fake'), 0) AS nf,
    coalesce(sum(weight) FILTER (label = 'real'), 0) AS nr
  FROM weights WHERE fold = 'train' GROUP BY term),
class_stats AS (
  SELECT ln((SELECT count(*) FILTER (label = 'fake') / count(*) FROM train_docs)) AS prior_fake,
    ln((SELECT count(*) FILTER (label = 'real') / count(*) FROM train_docs)) AS prior_real,
    sum(nf) + 0.1 * count(*) AS denom_fake, sum(nr) + 0.1 * count(*) AS denom_real FROM class_terms),
term_sums AS (
  SELECT w.doc_id, sum(w.weight * ln((t.nf + CAST(0.1 AS DOUBLE)) / s.denom_fake)) AS f,
    sum(w.weight * ln((t.nr + CAST(0.1 AS DOUBLE)) / s.denom_real)) AS r
  FROM weights w JOIN class_terms t USING (term), class_stats s WHERE w.fold = 'test' GROUP BY w.doc_id),
scores AS (
  SELECT d.doc_id, d.label, prior_fake + coalesce(f, 0) AS s_fake, prior_real + coalesce(r, 0) AS s_real,
    CASE WHEN prior_fake + coalesce(f, 0) >= prior_real + coalesce(r, 0) THEN 'fake' ELSE 'real' END AS verdict
  FROM test_docs d LEFT JOIN term_sums s ON d.doc_id = s.doc_id, class_stats)"""



def _logistic_steps() -> str:
    """CTEs up to the coefficients after the last step, one step after the other."""
    ctes = ["coefficients0 AS MATERIALIZED (SELECT DISTINCT term, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS u FROM entries)"]
    for i, limit in enumerate(islice(momentum_limits(), LOGISTIC_STEPS)):
        ctes.append(f"""missed{i} AS (
  SELECT e.doc_id, (1 / (1 + exp(-sum(e.x * k.u))) - any_value(e.y)) / any_value(p.n) AS r
  FROM entries e JOIN coefficients{i} k USING (term), pace p GROUP BY e.doc_id),
moved{i} AS (
  SELECT k.term, k.w AS old, k.u - (s.s + CASE WHEN k.term = '' THEN 0 ELSE k.u * p.penalty END) / p.bend AS w,
    least({limit!r}, (sqrt(p.bend / p.penalty) - 1) / (sqrt(p.bend / p.penalty) + 1)) AS momentum
  FROM coefficients{i} k JOIN (
    SELECT e.term, sum(e.x * m.r) AS s FROM entries e JOIN missed{i} m USING (doc_id) GROUP BY e.term) s USING (term), pace p),
coefficients{i + 1} AS MATERIALIZED (SELECT term, w, w + momentum * (w - old) AS u FROM moved{i})""")
    return ",\n".join(ctes)


LOGISTIC = f"""WITH {LABELLED},
{STRATIFIED_FOLD},
{TFIDF},
all_entries AS MATERIALIZED (
  SELECT doc_id, label, fold, term, weight AS x FROM weights
  UNION ALL SELECT doc_id, label, fold, '', CAST(1 AS DOUBLE) FROM folded),
entries AS MATERIALIZED (
  SELECT doc_id, CASE label WHEN 'fake' THEN 1.0 ELSE 0.0 END AS y, term, x FROM all_entries WHERE fold = 'train'),
pace AS MATERIALIZED (
  SELECT count(*) AS n, CAST(1 AS DOUBLE) / count(*) AS penalty, max(x2) / 4 + CAST(1 AS DOUBLE) / count(*) AS bend
  FROM (SELECT sum(x * x) AS x2 FROM entries GROUP BY doc_id)),
{_logistic_steps()},
probabilities AS (
  SELECT e.doc_id, any_value(e.label) AS label, 1 / (1 + exp(-sum(e.x * coalesce(k.w, 0)))) AS p_fake
  FROM all_entries e LEFT JOIN coefficients{LOGISTIC_STEPS} k USING (term) WHERE e.fold = 'test' GROUP BY e.doc_id),
scores AS (SELECT *, CASE WHEN p_fake > 0.5 THEN 'fake' ELSE 'real' END AS verdict FROM probabilities)"""

_SCORES = "SELECT doc_id, label, round(s_fake, 4) AS s_fake, round(s_real, 4) AS s_real, verdict FROM scores"



def held_out_a_sql(fold: str) -> str:
    return f"""WITH {LABELLED},
{fold},
train AS (SELECT * FROM folded WHERE fold = 'train'),
test AS (SELECT * FROM folded WHERE fold = 'test'),
{nb_ctes('train', 'a')},
{nb_score_ctes('test', 'a', 'count', 'label')}"""


HELD_OUT_A = held_out_a_sql(PREFIX_FOLD)

HELD_OUT_LEMMAS = f"""WITH {LABELLED},
{STRATIFIED_FOLD},
{BASED},
train AS (SELECT * FROM based WHERE fold = 'train'),
test AS (SELECT * FROM based WHERE fold = 'test'),
{nb_ctes('train', None)},
{nb_score_ctes('test', None, 'count', 'label')}"""


def _tokens_oracle(cleaner):
    return f"""SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {tokens_sql(cleaner)} AS toks FROM documents)"""


def _counts_oracle(cleaner):
    return f"WITH {LABELLED},\n{nb_ctes('labelled', cleaner)}\nSELECT w, n_fake, n_real FROM nb_counts"


ORACLES = {
    **{f"clean_tokens_{c}": _tokens_oracle(c) for c in "abc"},
    **{f"term_counts_{c}": _counts_oracle(c) for c in "abc"},
    "vocab_stats": f"""WITH {LABELLED},
{nb_ctes('labelled', 'a')}
SELECT CAST(docs_fake AS BIGINT) AS docs_fake, CAST(docs_real AS BIGINT) AS docs_real, vocab,
  CAST(tokens_fake AS BIGINT) AS tokens_fake, CAST(tokens_real AS BIGINT) AS tokens_real,
  round(prior_fake, 6) AS prior_fake, round(prior_real, 6) AS prior_real,
  round(unk_fake, 6) AS unk_fake, round(unk_real, 6) AS unk_real FROM nb_stats""",
    "nb_terms": f"""WITH {LABELLED},
{nb_ctes('labelled', 'a')}
SELECT w, round(ll_fake, 6) AS ll_fake, round(ll_real, 6) AS ll_real FROM nb_terms""",
    "prefix_split": f"WITH {LABELLED},\n{PREFIX_FOLD}\nSELECT doc_id, label, fold FROM folded",
    "stratified_split": f"WITH {LABELLED},\n{STRATIFIED_FOLD}\nSELECT doc_id, label, fold FROM folded",
    "split_totals": f"""WITH {LABELLED},
{STRATIFIED_FOLD}
SELECT fold, label, count(*) AS n_docs FROM folded GROUP BY fold, label""",
    "nb_scores": f"{HELD_OUT_A}\n{_SCORES}",
    "nb_probabilities": f"""WITH {LABELLED},
{nb_ctes('labelled', 'b')},
{nb_score_ctes('documents', 'b', 'skip')}
SELECT doc_id, round(p_fake, 6) AS p_fake FROM scores""",
    "nb_metrics": f"{HELD_OUT_A}\n{metrics_sql('scores')}",
    "prediction_flags": """SELECT d.doc_id, CASE WHEN l.quality IN (0, 1) THEN 1 - l.quality ELSE -1 END AS prediction
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "lemmas": f"""WITH all_words AS (SELECT DISTINCT unnest({tokens_sql('c')}) AS w FROM documents),
{lemma_ctes('all_words')}
SELECT w, lemma FROM lemmas""",
    "lemma_rounds": f"""WITH doc_words AS (SELECT DISTINCT unnest({tokens_sql('c')}) AS w FROM documents),
known AS (SELECT DISTINCT unnest({tokens_sql('c')}) AS w FROM conversations),
irregular AS (SELECT w || 'ren' AS w, w AS lemma FROM known),
regular AS (
  SELECT w FROM (SELECT w FROM doc_words UNION SELECT w || 'ss' FROM known) WHERE w NOT IN (SELECT w FROM irregular)),
{lemma_ctes('regular', " UNION ALL SELECT w, w, '', 1 FROM irregular UNION ALL SELECT w, lemma, '', 1 FROM irregular")}
SELECT w, lemma FROM lemmas""",
    "caller_tokeniser_counts": f"""WITH {LABELLED},
words AS (SELECT label, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM labelled)
SELECT w, count(*) FILTER (label = 'fake') AS n_fake, count(*) FILTER (label = 'real') AS n_real FROM words GROUP BY w""",
    "lemmatised_tokens": f"""WITH {lemmatised_ctes('documents')}
SELECT d.doc_id, coalesce(array_to_string(r.tokens, ' '), '') AS tokens
FROM documents d LEFT JOIN regrouped r ON d.doc_id = r.doc_id""",
    "nb_lemma_verdicts": f"{HELD_OUT_LEMMAS}\nSELECT doc_id, label, verdict FROM scores",
    "doc_freq": f"WITH {LABELLED},\n{STRATIFIED_FOLD},\n{TFIDF}\nSELECT term, df FROM doc_freq",
    "tfidf_weights": f"""WITH {LABELLED},
{STRATIFIED_FOLD},
{TFIDF}
SELECT doc_id, term, round(weight, 6) AS weight FROM weights WHERE fold = 'test'""",
    "tfidf_nb_scores": f"{TFIDF_NB}\n{_SCORES}",
    "tfidf_nb_metrics": f"{TFIDF_NB}\n{metrics_sql('scores')}",
    "logistic_scores": f"{LOGISTIC}\nSELECT doc_id, label, round(p_fake, 6) AS p_fake, verdict FROM scores",
}
