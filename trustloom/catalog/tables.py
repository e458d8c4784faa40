"""The driver tables in the roles the operators need, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions.constants import SOURCE, STOP_A, STOP_B, STOP_C, VEHICLE
from trustloom.functions.scalar import as_label
from trustloom.functions.text import tokeniser
from trustloom.sources.parquet import spread_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text)"""
    return spread_small(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, label) of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", as_label(F.col("quality")).alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id")


def with_tokens(docs: DataFrame, cleaner: str) -> DataFrame:
    return docs.withColumn("tokens", tokeniser(cleaner)(F.col("text"))).drop("text")


def behaviour_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, good)"""
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("good"))


def article_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ts, doc_id, good): one article every six hours."""
    labels = table(spark, sf_dir, "labels").select("doc_id", as_label(F.col("quality")).alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id")
    published = F.timestamp_add("HOUR", F.col("doc_id") * 6, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return docs.select("source", published.alias("ts"), "doc_id", (F.col("label") == "real").alias("good"))


def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): who viewed whom, without self loops, parallel edges kept."""
    views = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    cited = F.get_json_object("props", "$.k").cast("bigint")
    return views.select(F.col("user_id").alias("src"), cited.alias("dst")).where(F.col("src") != F.col("dst"))


def direct_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, direct): share of events without error, for every user with an event."""
    users = table(spark, sf_dir, "events")
    share = F.avg((F.col("event_type") != "error").cast("double"))
    return users.groupBy(F.col("user_id").alias("node")).agg(share.alias("direct"))


def declared_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node): every customer; one without events is in the graph with the default trust."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))


def named_sources(trust: DataFrame) -> DataFrame:
    """Node numbers as the source names of the documents."""
    return trust.select(F.concat(F.lit("src"), (F.col("node") + 5).cast("string")).alias("node"), "trust")


# --- the same in SQL -------------------------------------------------------------------------------------------------


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


LABELLED = """labelled AS (
  SELECT d.doc_id, d.source, d.text, CASE WHEN l.quality = 1 THEN 'real' ELSE 'fake' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# Whitespace as the inside of a character class.
WHITESPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_KEEP = "list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains([{stop}], w))"


def tokens_sql(cleaner: str, text: str = "text") -> str:
    if cleaner == "a":
        words = f"string_split_regex(regexp_replace(lower({text}), '[^a-z ]+', '', 'g'), ' +')"
        return _KEEP.format(words=words, stop=quoted(STOP_A))
    letters = f"regexp_replace(lower({text}), '[^a-z{WHITESPACE}]+', '', 'g')"
    if cleaner == "c":
        for head, tail in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")):
            letters = rf"regexp_replace({letters}, '\b{head}{tail}\b', '{head} {tail}', 'g')"
    words = f"string_split_regex({letters}, '[{WHITESPACE}]+')"
    return _KEEP.format(words=words, stop=quoted(STOP_B if cleaner == "b" else STOP_C))


def digest_sql(seed: int, *ids: str) -> str:
    return "md5(" + f"'{seed}'" + "".join(f" || '|' || CAST({i} AS VARCHAR)" for i in ids) + ")"


PREFIX_FOLD = f"""folded AS (
  SELECT doc_id, source, text, label,
    CASE WHEN row_number() OVER (ORDER BY {digest_sql(42, 'doc_id')}) <= floor(count(*) OVER () * 0.8)
      THEN 'train' ELSE 'test' END AS fold
  FROM labelled)"""

# Two classes: the train rows of a class are its exact share rounded down, plus one for the larger remainder.
STRATIFIED_FOLD = f"""class_sizes AS (
  SELECT count(*) AS n, count(*) - ceil(count(*) * 0.25) AS n_train,
    count(*) FILTER (label = 'fake') AS nf, count(*) FILTER (label = 'real') AS nr FROM labelled),
class_cuts AS (
  SELECT nf, nr, n_train, nf * n_train / n AS xf, nr * n_train / n AS xr,
    n_train - floor(nf * n_train / n) - floor(nr * n_train / n) AS missing FROM class_sizes),
class_tests AS (
  SELECT 'fake' AS label,
    nf - floor(xf) - CASE WHEN missing > 0 AND xf - floor(xf) >= xr - floor(xr) THEN 1 ELSE 0 END AS n_test
  FROM class_cuts
  UNION ALL
  SELECT 'real',
    nr - floor(xr) - CASE WHEN missing > 0 AND xf - floor(xf) < xr - floor(xr) THEN 1 ELSE 0 END
  FROM class_cuts),
folded AS (
  SELECT l.doc_id, l.source, l.text, l.label,
    CASE WHEN row_number() OVER (PARTITION BY l.label ORDER BY {digest_sql(42, 'l.doc_id')}) <= t.n_test
      THEN 'test' ELSE 'train' END AS fold
  FROM labelled l JOIN class_tests t ON l.label = t.label)"""


def nb_ctes(train: str, cleaner: str | None, smoothing: float = 1.0, tokens: str = "tokens") -> str:
    """CTEs nb_counts, nb_stats, nb_terms over a relation ``train(doc_id, label, text)``, or ``tokens`` if no cleaner."""
    words = tokens_sql(cleaner) if cleaner else tokens
    return f"""nb_words AS (SELECT label, unnest({words}) AS w FROM {train}),
nb_counts AS (
  SELECT w, count(*) FILTER (label = 'fake') AS n_fake, count(*) FILTER (label = 'real') AS n_real
  FROM nb_words GROUP BY w),
nb_stats AS (
  SELECT docs_fake, docs_real, vocab, tokens_fake, tokens_real,
    ln(docs_fake / (docs_fake + docs_real)) AS prior_fake, ln(docs_real / (docs_fake + docs_real)) AS prior_real,
    tokens_fake + {smoothing} * vocab AS denom_fake, tokens_real + {smoothing} * vocab AS denom_real,
    ln({smoothing} / (tokens_fake + {smoothing} * vocab)) AS unk_fake,
    ln({smoothing} / (tokens_real + {smoothing} * vocab)) AS unk_real
  FROM (SELECT count(*) AS vocab, CAST(sum(n_fake) AS DOUBLE) AS tokens_fake,
          CAST(sum(n_real) AS DOUBLE) AS tokens_real FROM nb_counts),
       (SELECT CAST(count(*) FILTER (label = 'fake') AS DOUBLE) AS docs_fake,
          CAST(count(*) FILTER (label = 'real') AS DOUBLE) AS docs_real FROM {train})),
nb_terms AS (
  SELECT w, ln((n_fake + {smoothing}) / denom_fake) AS ll_fake, ln((n_real + {smoothing}) / denom_real) AS ll_real
  FROM nb_counts, nb_stats)"""


def nb_score_ctes(docs: str, cleaner: str | None, unknown: str, keep: str = "", tokens: str = "tokens") -> str:
    """CTEs score_words, scores(doc_id, keep.., s_fake, s_real, p_fake, verdict) over ``docs``."""
    words = tokens_sql(cleaner) if cleaner else tokens
    unk = ("unk_fake", "unk_real") if unknown == "count" else ("0.0", "0.0")
    extra = "".join(f", d.{k}" for k in keep.split()) if keep else ""
    return f"""score_words AS (SELECT doc_id, unnest({words}) AS w FROM {docs}),
score_sums AS (
  SELECT doc_id, sum(coalesce(t.ll_fake, {unk[0]})) AS f, sum(coalesce(t.ll_real, {unk[1]})) AS r
  FROM score_words LEFT JOIN nb_terms t USING (w), nb_stats GROUP BY doc_id),
score_margins AS (
  SELECT d.doc_id{extra}, prior_fake + coalesce(f, 0) AS s_fake, prior_real + coalesce(r, 0) AS s_real
  FROM {docs} d LEFT JOIN score_sums s ON d.doc_id = s.doc_id, nb_stats),
scores AS (
  SELECT *, CASE WHEN s_real - s_fake > 700 THEN 0.0 ELSE 1 / (1 + exp(s_real - s_fake)) END AS p_fake,
    CASE WHEN s_fake > s_real THEN 'fake' ELSE 'real' END AS verdict
  FROM score_margins)"""


def metrics_sql(predictions: str) -> str:
    """tp..f1 over ``predictions(label, verdict)``, rounded to 6 digits."""
    return f"""
  SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
    round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
  FROM (
    SELECT tp, fp, fn, tn, (tp + tn) / n AS accuracy,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
    FROM (
      SELECT count(*) FILTER (verdict = 'fake' AND label = 'fake') AS tp,
        count(*) FILTER (verdict = 'fake' AND label = 'real') AS fp,
        count(*) FILTER (verdict = 'real' AND label = 'fake') AS fn,
        count(*) FILTER (verdict = 'real' AND label = 'real') AS tn, count(*) AS n
      FROM {predictions}))"""


EDGES = """edges AS (
  SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst FROM events
  WHERE event_type = 'view' AND user_id <> CAST(json_extract_string(props, '$.k') AS BIGINT))"""

DIRECT = """direct AS (
  SELECT user_id AS node, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS direct
  FROM events GROUP BY user_id)"""


def trust_ctes(iterations: int = 10, damping: float = 0.85) -> str:
    """CTEs up to ``trust(node, trust)``; one per round."""
    ctes = [
        EDGES, DIRECT,
        """nodes AS (
  SELECT n.node, coalesce(d.direct, 0.5) AS direct
  FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges UNION SELECT c_custkey FROM customer) n
  LEFT JOIN direct d ON n.node = d.node)""",
        "round0 AS MATERIALIZED (SELECT node, direct, direct AS trust FROM nodes)",
    ]
    for i in range(1, iterations + 1):
        ctes.append(f"""round{i} AS MATERIALIZED (
  SELECT n.node, n.direct, {1 - damping!r} * n.direct + {damping!r} * coalesce(c.mean, 0.5) AS trust
  FROM nodes n LEFT JOIN (SELECT e.dst, avg(t.trust) AS mean FROM edges e JOIN round{i - 1} t ON e.src = t.node
    GROUP BY e.dst) c ON n.node = c.dst)""")
    ctes.append(f"trust AS (SELECT node, trust FROM round{iterations})")
    return ",\n".join(ctes)


BEHAVIOUR_EVENTS = "SELECT user_id AS k, ts, event_id AS seq, event_type <> 'error' AS good FROM events"
ARTICLE_EVENTS = """
  SELECT d.source AS k, TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id * 6 AS INTEGER)) AS ts, d.doc_id AS seq,
    l.quality = 1 AS good
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def fold_ctes(events: str, params: dict) -> str:
    """CTEs up to ``folded(k, ts, seq, good, gap, trust)``: the fold as a recursion over each key's events."""
    unit = {"hour": "3600e6", "day": "86400e6"}[params["unit"]]
    step = (
        "CASE WHEN good THEN x + {reward} * (100 - x) ELSE x * {keep} END".format(**params)
    )
    return f"""ordered AS MATERIALIZED (
  SELECT k, ts, seq, good, row_number() OVER w AS i, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us
  FROM ({events}) WINDOW w AS (PARTITION BY k ORDER BY ts, seq)),
walk AS (
  SELECT k, i, {step.replace('x', 'CAST(50 AS DOUBLE)')} AS trust FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.k, o.i, {step.replace('x', f"(w.trust * exp(-{params['rate']} * o.gap_us / {unit}))")}
  FROM walk w JOIN ordered o ON o.k = w.k AND o.i = w.i + 1),
folded AS (
  SELECT o.k, o.ts, o.seq, o.good, o.i, o.gap_us / {unit} AS gap,
    exp(-{params['rate']} * o.gap_us / {unit}) AS decay, greatest(0.0, least(100.0, w.trust)) AS trust
  FROM ordered o JOIN walk w ON o.k = w.k AND o.i = w.i)"""


VEHICLE_FOLD = "WITH RECURSIVE " + fold_ctes(BEHAVIOUR_EVENTS, VEHICLE)
SOURCE_FOLD = "WITH RECURSIVE " + fold_ctes(ARTICLE_EVENTS, SOURCE)
