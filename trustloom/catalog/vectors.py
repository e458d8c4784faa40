"""Queries on word ids, sequences, training pairs, vectors and the comparison of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.catalog.content import (
    BASED,
    HELD_OUT_LEMMAS,
    LOGISTIC,
    TFIDF_NB,
    base_sides,
    held_out_a,
    held_out_a_sql,
    held_out_lemmas,
    held_out_logistic,
    held_out_tfidf_nb,
    rounded_metrics,
    stratified_fold,
)
from trustloom.catalog.tables import (
    LABELLED,
    STRATIFIED_FOLD,
    documents,
    metrics_sql,
    table,
    tokens_sql,
    with_tokens,
)
from trustloom.functions.scalar import cosine
from trustloom.operators.metrics import compare
from trustloom.operators.vectors import doc_vectors, nearest, prototypes, word_vectors
from trustloom.operators.vocabulary import (
    negative_pairs,
    padded_sequences,
    sequence_vocabulary,
    skipgrams,
    training_pairs,
    vocabulary,
    word_ids,
)
from trustloom.session import materialise

DIM = 64
TRAINED_DIM, EPOCHS, BATCHES, RATE = 50, 3, 2, 0.5


def vocab_ids(spark, sf_dir):
    return vocabulary(with_tokens(documents(spark, sf_dir), "c"))


def _sequences(spark, sf_dir):
    docs = with_tokens(documents(spark, sf_dir), "c")
    vocab = vocabulary(docs)
    return word_ids(docs, vocab), vocab


def word_id_sequences(spark, sf_dir):
    sequences, _ = _sequences(spark, sf_dir)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return sequences.select("doc_id", F.size("ids").alias("n_ids"), ids.alias("ids"))


def padded_word_sequences(spark, sf_dir):
    docs = documents(spark, sf_dir)
    padded = padded_sequences(docs, sequence_vocabulary(docs))
    return padded.select("doc_id", F.array_join(F.transform("seq", lambda i: i.cast("string")), " ").alias("seq"))


def _by_center(pairs):
    return pairs.groupBy("center").agg(
        F.count("*").alias("n_pairs"),
        F.sum("context").alias("sum_context"),
        F.sum(F.col("context") * F.col("context_pos")).alias("weighted_context"),
    )


def skipgram_pairs(spark, sf_dir):
    sequences, _ = _sequences(spark, sf_dir)
    return _by_center(skipgrams(sequences))


def negative_pair_draws(spark, sf_dir):
    sequences, vocab = _sequences(spark, sf_dir)
    totals = negative_pairs(skipgrams(sequences, runs=True), vocab.count() + 1, totals=True)
    return totals.groupBy("center").agg(
        *(F.sum(c).alias(c) for c in ("n_pairs", "sum_context", "weighted_context"))
    )


def training_pair_totals(spark, sf_dir):
    sequences, vocab = _sequences(spark, sf_dir)
    pairs = training_pairs(skipgrams(sequences), vocab.count() + 1)
    return pairs.groupBy("doc_id", "label").agg(F.count("*").alias("n_pairs"))


def _given_vectors(spark, sf_dir, docs):
    """Vectors of the embeddings table handed to the words in turn."""
    given = table(spark, sf_dir, "embeddings")
    n = given.count()
    given = given.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vec"))
    vectors = vocabulary(docs).withColumn("_v", F.col("id") % n).join(given, "_v").select("w", "id", "vec")
    return materialise(vectors, "word-vectors")


def _rounded_dims(df, *ids):
    return df.select(*ids, F.posexplode("vec").alias("dim", "x")).select(*ids, "dim", F.round("x", 6).alias("x"))


def doc_mean_vectors(spark, sf_dir):
    docs = with_tokens(documents(spark, sf_dir), "c")
    means = doc_vectors(docs, _given_vectors(spark, sf_dir, docs), dim=DIM)
    return _rounded_dims(means, "doc_id", "n_known")


def held_out_prototypes(spark, sf_dir, train, test):
    vectors = _given_vectors(spark, sf_dir, train)
    protos = prototypes(doc_vectors(train, vectors, dim=DIM, keep=("label",)), dim=DIM)
    return nearest(doc_vectors(test, vectors, dim=DIM, keep=("label",)), protos, dim=DIM)


def doc_prototype_verdicts(spark, sf_dir):
    judged = held_out_prototypes(spark, sf_dir, *base_sides(spark, sf_dir))
    return judged.select(
        "doc_id", "label", F.round("sim_fake", 6).alias("sim_fake"), F.round("sim_real", 6).alias("sim_real"), "verdict"
    )


def _embedded(spark, sf_dir):
    named = F.when(F.col("label") == 0, "fake").when(F.col("label") == 1, "real")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), named.alias("label"))


def class_prototypes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec"), "label")
    return _rounded_dims(prototypes(vectors, dim=DIM), "label")


def nearest_prototypes(spark, sf_dir):
    vectors = _embedded(spark, sf_dir)
    protos = prototypes(vectors.where(F.col("label").isNotNull()), dim=DIM)
    judged = nearest(vectors, protos, dim=DIM)
    return judged.select(
        "vec_id", F.round("sim_fake", 6).alias("sim_fake"), F.round("sim_real", 6).alias("sim_real"), "verdict"
    )


def neighbour_cosine(spark, sf_dir):
    """Cosine of every vector with the next one by id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = vectors.join(following, "vec_id")
    return both.select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def trained_prototype_verdicts(spark, sf_dir):
    """Prototypes on vectors trained from the train side."""
    judged = _held_out_word2vec(*base_sides(spark, sf_dir))
    return judged.select(
        "doc_id", "label", F.round("sim_fake", 6).alias("sim_fake"), F.round("sim_real", 6).alias("sim_real"), "verdict"
    )


def _held_out_word2vec(train, test):
    vectors = word_vectors(train, vocabulary(train), dim=TRAINED_DIM, epochs=EPOCHS, batches=BATCHES, rate=RATE)
    protos = prototypes(doc_vectors(train, vectors, dim=TRAINED_DIM, keep=("label",)), dim=TRAINED_DIM)
    return nearest(doc_vectors(test, vectors, dim=TRAINED_DIM, keep=("label",)), protos, dim=TRAINED_DIM)


def _judged(df):
    return df.select("label", "verdict")


def model_comparison(spark, sf_dir):
    """All models on the same held-out documents."""
    train, test = base_sides(spark, sf_dir)
    rows = compare({
        "naive bayes a": _judged(held_out_a(stratified_fold(spark, sf_dir))),
        "naive bayes lemmas": _judged(held_out_lemmas(train, test)),
        "tf-idf naive bayes": _judged(held_out_tfidf_nb(train, test)),
        "prototypes": _judged(held_out_prototypes(spark, sf_dir, train, test)),
    })
    return rounded_metrics(rows)


def trained_model_comparison(spark, sf_dir):
    """The models whose fit is iterative."""
    train, test = base_sides(spark, sf_dir)
    rows = compare({
        "tf-idf logistic regression": _judged(held_out_logistic(train, test)),
        "word vectors": _judged(_held_out_word2vec(train, test)),
    })
    return rounded_metrics(rows)


QUERIES = {
    "vocab_ids": vocab_ids,
    "word_id_sequences": word_id_sequences,
    "padded_word_sequences": padded_word_sequences,
    "skipgram_pairs": skipgram_pairs,
    "negative_pair_draws": negative_pair_draws,
    "training_pair_totals": training_pair_totals,
    "doc_mean_vectors": doc_mean_vectors,
    "doc_prototype_verdicts": doc_prototype_verdicts,
    "class_prototypes": class_prototypes,
    "nearest_prototypes": nearest_prototypes,
    "neighbour_cosine": neighbour_cosine,
    "trained_prototype_verdicts": trained_prototype_verdicts,
    "model_comparison": model_comparison,
    "trained_model_comparison": trained_model_comparison,
}


# --- SQL -------------------------------------------------------------------------------------------------------------


def vocab_cte(docs: str, tokens: str = tokens_sql("c")) -> str:
    return f"""vocab AS MATERIALIZED (
  SELECT w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5(w)) AS id
  FROM (SELECT unnest({tokens}) AS w FROM {docs}) GROUP BY w HAVING count(*) >= 2)"""


def sequence_ctes(docs: str, tokens: str) -> str:
    """CTEs up to ``pairs(doc_id, center_pos, context_pos, center, context)`` of ``docs``."""
    return f"""{vocab_cte(docs, tokens)},
token_rows AS (
  SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS pos
  FROM (SELECT doc_id, {tokens} AS toks FROM {docs})),
id_rows AS MATERIALIZED (
  SELECT t.doc_id, t.pos, coalesce(v.id, 0) AS id FROM token_rows t LEFT JOIN vocab v USING (w)),
pairs AS (
  SELECT a.doc_id, a.pos AS center_pos, b.pos AS context_pos, a.id AS center, b.id AS context
  FROM (SELECT *, unnest(range(-5, 6)) AS step FROM id_rows) a
  JOIN id_rows b ON a.doc_id = b.doc_id AND b.pos = a.pos + a.step AND a.step <> 0)"""


SEQUENCES = sequence_ctes("documents", tokens_sql("c"))

_BY_CENTER = """SELECT center, count(*) AS n_pairs, CAST(sum(context) AS BIGINT) AS sum_context,
  CAST(sum(context * context_pos) AS BIGINT) AS weighted_context FROM {pairs} GROUP BY center"""

_DRAW = "CAST(CAST('0x' || substr(d, {at}, 15) AS BIGINT) % (SELECT count(*) + 1 FROM vocab) AS BIGINT)"
DRAWS = f"""draws AS (
  SELECT center_pos, context_pos, {_DRAW.format(at=1)} AS center, {_DRAW.format(at=16)} AS context
  FROM (SELECT *, md5('42|' || doc_id || '|' || center_pos || '|' || context_pos) AS d FROM pairs))"""


def _sequence_words(text: str) -> str:
    blanked = f"""regexp_replace(lower({text}), '[!"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~\\t\\n]', ' ', 'g')"""
    return f"list_filter(string_split({blanked}, ' '), lambda w: w <> '')"


def _mean_columns(vec: str, dim: int = DIM) -> str:
    return ", ".join(f"avg({vec}[{i}])" for i in range(1, dim + 1))


def mean_ctes(docs: str, tokens: str, dim: int) -> str:
    """CTE ``doc_means(doc_id, n_known, vec)`` of ``docs`` from ``vectors(w, vec)``."""
    return f"""known_means AS (
  SELECT doc_id, count(*) AS n_known, [{_mean_columns('vec', dim)}] AS vec
  FROM (SELECT doc_id, unnest({tokens}) AS w FROM {docs}) JOIN vectors USING (w) GROUP BY doc_id),
doc_means AS (
  SELECT d.doc_id, coalesce(k.n_known, 0) AS n_known,
    coalesce(k.vec, list_transform(range({dim}), lambda i: CAST(0 AS DOUBLE))) AS vec
  FROM {docs} d LEFT JOIN known_means k ON d.doc_id = k.doc_id)"""


def doc_vector_ctes(docs: str, train: str, tokens: str = tokens_sql("c")) -> str:
    """The same with vectors of the embeddings table for the words of ``train``."""
    return f"""{vocab_cte(train, tokens)},
vectors AS MATERIALIZED (
  SELECT v.w, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM vocab v JOIN embeddings e ON e.vec_id = v.id % (SELECT count(*) FROM embeddings)),
{mean_ctes(docs, tokens, DIM)}"""


def _cosine(a: str, b: str) -> str:
    norms = f"sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))"
    return f"CASE WHEN {norms} > 0 THEN list_dot_product({a}, {b}) / ({norms}) ELSE 0 END"


def _near(vectors: str, protos: str, ids: str) -> str:
    """Similarities and verdict of ``vectors(ids, vec)`` to ``protos(label, vec)``."""
    return f"""likeness AS (
  SELECT {ids}, {_cosine('vec', 'f')} AS sim_fake, {_cosine('vec', 'r')} AS sim_real
  FROM {vectors}, (SELECT any_value(vec) FILTER (label = 'fake') AS f, any_value(vec) FILTER (label = 'real') AS r
    FROM {protos})),
nearest AS (SELECT *, CASE WHEN sim_fake > sim_real THEN 'fake' ELSE 'real' END AS verdict FROM likeness)"""


def _prototype_ctes(dim: int) -> str:
    """From ``doc_means`` to ``nearest``: prototypes of the train side, verdicts on the other."""
    return f"""sided AS (SELECT f.doc_id, f.label, f.fold, m.vec FROM folded f JOIN doc_means m ON f.doc_id = m.doc_id),
protos AS (
  SELECT label, [{_mean_columns('vec', dim)}] AS vec FROM sided
  WHERE fold = 'train' AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY label),
tested AS (SELECT doc_id, label, vec FROM sided WHERE fold = 'test'),
{_near('tested', 'protos', 'doc_id, label')}"""


_SIDES = f"""WITH {LABELLED},
{STRATIFIED_FOLD},
{BASED},
train AS (SELECT * FROM based WHERE fold = 'train')"""

HELD_OUT_PROTOTYPES = f"""{_SIDES},
{doc_vector_ctes('based', 'train', 'tokens')},
{_prototype_ctes(DIM)}"""


def _start_sql() -> str:
    """The numbers a vector starts with, from digests of its id."""
    draw = "CAST('0x' || substr(md5('42|' || id || '|' || (i // 2)), 1 + 15 * (i % 2), 15) AS BIGINT) % 1048576"
    return f"list_transform(range({TRAINED_DIM}), lambda i: ({draw} / CAST(1048576 AS DOUBLE) - 0.5) * 0.1)"


def _training_ctes() -> str:
    """CTEs up to ``vectors(w, vec)``, one a step."""
    sums = ", ".join(f"sum(e * y[{i}])" for i in range(1, TRAINED_DIM + 1))
    ctes = [f"""{sequence_ctes('train', 'tokens')},
{DRAWS},
paired AS (
  SELECT center AS a, context AS b, 1 AS label FROM pairs UNION ALL SELECT context, center, 1 FROM pairs
  UNION ALL SELECT center, context, 0 FROM draws UNION ALL SELECT context, center, 0 FROM draws),
pair_weights AS MATERIALIZED (
  SELECT a, b, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg, (a + b) % {BATCHES} AS batch
  FROM paired GROUP BY a, b),
state0 AS MATERIALIZED (
  SELECT id, {_start_sql()} AS vec, CAST(0 AS DOUBLE) AS power FROM (SELECT id FROM vocab UNION ALL SELECT 0))"""]
    for k in range(EPOCHS * BATCHES):
        ctes.append(f"""gradients{k} AS (
  SELECT id, [{sums}] AS g FROM (
    SELECT id, y, pos * (1 - p) - neg * p AS e FROM (
      SELECT w.a AS id, y.vec AS y, w.pos, w.neg, 1 / (1 + exp(-list_dot_product(x.vec, y.vec))) AS p
      FROM pair_weights w JOIN state{k} x ON x.id = w.a JOIN state{k} y ON y.id = w.b WHERE w.batch = {k % BATCHES}))
  GROUP BY id),
powers{k} AS (
  SELECT s.id, s.vec, g.g, s.power + coalesce(list_dot_product(g.g, g.g), 0) AS power
  FROM state{k} s LEFT JOIN gradients{k} g ON s.id = g.id),
state{k + 1} AS MATERIALIZED (
  SELECT id, power, CASE WHEN g IS NULL OR power = 0 THEN vec
    ELSE list_transform(list_zip(vec, g), lambda z: z[1] + {RATE} / sqrt(power) * z[2]) END AS vec FROM powers{k})""")
    ctes.append(f"""vectors AS MATERIALIZED (
  SELECT v.w, s.vec FROM vocab v JOIN state{EPOCHS * BATCHES} s ON s.id = v.id),
{mean_ctes('based', 'tokens', TRAINED_DIM)}""")
    return ",\n".join(ctes)


HELD_OUT_TRAINED = f"""{_SIDES},
{_training_ctes()},
{_prototype_ctes(TRAINED_DIM)}"""

EMBEDDED = f"""embedded AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec,
    CASE label WHEN 0 THEN 'fake' WHEN 1 THEN 'real' END AS label FROM embeddings),
protos AS (SELECT label, [{_mean_columns('vec')}] AS vec FROM embedded WHERE label IS NOT NULL GROUP BY label)"""


def _compared(*models: tuple[str, str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS model, * FROM ({ctes}\n{metrics_sql(predictions)})" for name, ctes, predictions in models)


_SIMILARITIES = "round(sim_fake, 6) + 0.0 AS sim_fake, round(sim_real, 6) + 0.0 AS sim_real, verdict"

ORACLES = {
    "vocab_ids": f"WITH {vocab_cte('documents')}\nSELECT w, n, id FROM vocab",
    "word_id_sequences": f"""WITH {SEQUENCES}
SELECT d.doc_id, CAST(count(i.id) AS INTEGER) AS n_ids, coalesce(string_agg(i.id, ' ' ORDER BY i.pos), '') AS ids
FROM documents d LEFT JOIN id_rows i ON d.doc_id = i.doc_id GROUP BY d.doc_id""",
    "padded_word_sequences": f"""WITH word_lists AS MATERIALIZED (
  SELECT doc_id, {_sequence_words('text')} AS ws FROM documents),
ranked AS (
  SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS i
  FROM (SELECT unnest(ws) AS w FROM word_lists) GROUP BY w),
placed AS (SELECT doc_id, unnest(ws[1:250]) AS w, generate_subscripts(ws[1:250], 1) AS pos FROM word_lists),
known AS (
  SELECT p.doc_id, p.pos, CASE WHEN r.i <= 9998 THEN r.i + 1 ELSE 1 END AS id FROM placed p LEFT JOIN ranked r USING (w))
SELECT d.doc_id, coalesce(string_agg(k.id, ' ' ORDER BY k.pos) ||
    CASE WHEN count(k.id) < 250 THEN repeat(' 0', CAST(250 - count(k.id) AS INTEGER)) ELSE '' END,
    trim(repeat('0 ', 250))) AS seq
FROM documents d LEFT JOIN known k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
    "skipgram_pairs": f"WITH {SEQUENCES}\n{_BY_CENTER.format(pairs='pairs')}",
    "negative_pair_draws": f"WITH {SEQUENCES},\n{DRAWS}\n{_BY_CENTER.format(pairs='draws')}",
    "training_pair_totals": f"""WITH {SEQUENCES}
SELECT doc_id, label, count(*) AS n_pairs FROM pairs, (SELECT unnest([0, 1]) AS label) GROUP BY doc_id, label""",
    "doc_mean_vectors": f"""WITH {doc_vector_ctes('documents', 'documents')}
SELECT doc_id, n_known, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(unnest(vec), 6) + 0.0 AS x
FROM doc_means""",
    "doc_prototype_verdicts": f"{HELD_OUT_PROTOTYPES}\nSELECT doc_id, label, {_SIMILARITIES} FROM nearest",
    "class_prototypes": f"""WITH protos AS (SELECT label, [{_mean_columns('embedding')}] AS vec FROM embeddings GROUP BY label)
SELECT label, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(unnest(vec), 6) + 0.0 AS x FROM protos""",
    "nearest_prototypes": f"""WITH {EMBEDDED},
{_near('embedded', 'protos', 'vec_id')}
SELECT vec_id, {_SIMILARITIES} FROM nearest""",
    "neighbour_cosine": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT a.vec_id, round({_cosine('a.vec', 'b.vec')}, 6) + 0.0 AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "trained_prototype_verdicts": f"{HELD_OUT_TRAINED}\nSELECT doc_id, label, {_SIMILARITIES} FROM nearest",
    "model_comparison": _compared(
        ("naive bayes a", held_out_a_sql(STRATIFIED_FOLD), "scores"),
        ("naive bayes lemmas", HELD_OUT_LEMMAS, "scores"),
        ("tf-idf naive bayes", TFIDF_NB, "scores"),
        ("prototypes", HELD_OUT_PROTOTYPES, "nearest"),
    ),
    "trained_model_comparison": _compared(
        ("tf-idf logistic regression", LOGISTIC, "scores"),
        ("word vectors", HELD_OUT_TRAINED, "nearest"),
    ),
}
