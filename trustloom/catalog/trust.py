"""Queries on trust over time, the citation graph and the hybrid verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.catalog.tables import (
    EDGES,
    LABELLED,
    SOURCE_FOLD,
    VEHICLE_FOLD,
    article_events,
    behaviour_events,
    citation_edges,
    declared_nodes,
    direct_trust,
    documents,
    fold_ctes,
    labelled,
    named_sources,
    nb_ctes,
    nb_score_ctes,
    table,
    trust_ctes,
    with_tokens,
)
from trustloom.functions.constants import SOURCE, VEHICLE
from trustloom.operators.graph import citers, source_trust
from trustloom.operators.naive_bayes import nb_fit
from trustloom.operators.reputation import (
    known_entities,
    latest,
    read_scores,
    trust_fold,
    unknown_entities,
    with_account,
)
from trustloom.plans.hybrid import hybrid


SELECTED_UP_TO = 12
NOW = "2030-01-01 00:00:00"


def hourly(spark, sf_dir):
    events = behaviour_events(spark, sf_dir)
    return trust_fold(events, key="user_id", ts="ts", seq="event_id", good=F.col("good"), **VEHICLE)


def daily(spark, sf_dir):
    events = article_events(spark, sf_dir)
    return trust_fold(events, key="source", ts="ts", seq="doc_id", good=F.col("good"), **SOURCE)


def trust_latest(spark, sf_dir):
    newest = latest(hourly(spark, sf_dir), key="user_id", order=("ts", "event_id"), values=("trust", "score"))
    return newest.select("user_id", F.round("trust", 6).alias("trust"), "score")


def trust_history_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).select("user_id", "ts", "event_id", F.round("trust", 6).alias("trust"), "score")


def trust_history_daily(spark, sf_dir):
    return daily(spark, sf_dir).select("source", "ts", "doc_id", F.round("trust", 6).alias("trust"), "score")


def trust_history_selected(spark, sf_dir):
    """Only the events of the chosen users are read and folded."""
    events = behaviour_events(spark, sf_dir).where(F.col("user_id") <= SELECTED_UP_TO)
    history = trust_fold(events, key="user_id", ts="ts", seq="event_id", good=F.col("good"), **VEHICLE)
    return history.select("user_id", "ts", "score")


def source_report(spark, sf_dir):
    newest = latest(daily(spark, sf_dir), key="source", order=("ts", "doc_id"), values=("score",))
    return newest.orderBy("source")


def event_gaps(spark, sf_dir):
    return hourly(spark, sf_dir).select(
        "user_id", "event_id", F.round("gap", 6).alias("gap_hours"), F.round("decay", 6).alias("decay")
    )


def score_reads(spark, sf_dir):
    """Users and registered suppliers asked for their score; those never seen read 50."""
    newest = latest(hourly(spark, sf_dir), key="user_id", order=("ts", "event_id"), values=("trust",))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return read_scores(asked.unionByName(users), newest, key="user_id", default=50)


def _registered(spark, sf_dir, pick):
    registry = table(spark, sf_dir, "supplier")
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    picked = pick(events, registry, key="user_id", registry_key="s_suppkey")
    return picked.groupBy("user_id").agg(F.count("*").alias("n_events"))


def known_entity_events(spark, sf_dir):
    return _registered(spark, sf_dir, known_entities)


def unknown_entity_events(spark, sf_dir):
    return _registered(spark, sf_dir, unknown_entities)


def entity_accounts(spark, sf_dir):
    """Events of every user under the name of the supplier with that number."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    registry = table(spark, sf_dir, "supplier")
    known = with_account(events, registry, key="user_id", registry_key="s_suppkey", account="s_name")
    return known.groupBy("user_id", "s_name").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


def missing_event_times(spark, sf_dir):
    """Views have lost their time and count as of now."""
    events = table(spark, sf_dir, "events").select(
        "user_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("ts"), "event_id",
        (F.col("event_type") != "error").alias("good"))
    folded = trust_fold(
        events, key="user_id", ts="ts", seq="event_id", good=F.col("good"), now=F.lit(NOW).cast("timestamp_ntz"), **VEHICLE)
    return folded.select("user_id", "ts", "event_id", F.round("trust", 6).alias("trust"), "score")


def citation_citers(spark, sf_dir):
    return citers(citation_edges(spark, sf_dir))


def _trust(spark, sf_dir):
    declared = declared_nodes(spark, sf_dir)
    return source_trust(citation_edges(spark, sf_dir), direct_trust(spark, sf_dir), declared=declared)


def citation_trust(spark, sf_dir):
    trust = _trust(spark, sf_dir)
    return trust.select("node", F.round("trust", 6).alias("trust"))


def hybrid_verdicts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = nb_fit(with_tokens(labelled(spark, sf_dir), "b"))
    trust = _trust(spark, sf_dir)
    judged = hybrid(with_tokens(docs, "b"), model, named_sources(trust))
    return judged.select(
        "doc_id", "source",
        *[F.round(c, 6).alias(c) for c in ("content_fake_score", "source_trust_score", "final_fake_score")],
        "verdict",
    )


QUERIES = {
    "trust_latest": trust_latest,
    "trust_history_hourly": trust_history_hourly,
    "trust_history_daily": trust_history_daily,
    "trust_history_selected": trust_history_selected,
    "source_report": source_report,
    "event_gaps": event_gaps,
    "score_reads": score_reads,
    "known_entity_events": known_entity_events,
    "unknown_entity_events": unknown_entity_events,
    "entity_accounts": entity_accounts,
    "missing_event_times": missing_event_times,
    "citation_citers": citation_citers,
    "citation_trust": citation_trust,
    "hybrid_verdicts": hybrid_verdicts,
}

UNTIMED_EVENTS = """
  SELECT user_id AS k, CASE WHEN event_type = 'view' THEN TIMESTAMP '{now}' ELSE ts END AS ts, event_id AS seq,
    event_type <> 'error' AS good FROM events"""
SCORE = "CAST(round_even(trust, 0) AS INTEGER)"

ORACLES = {
    "trust_latest": f"""{VEHICLE_FOLD}
SELECT k AS user_id, round(trust, 6) AS trust, {SCORE} AS score FROM folded
QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1""",
    "trust_history_hourly": f"""{VEHICLE_FOLD}
SELECT k AS user_id, ts, seq AS event_id, round(trust, 6) AS trust, {SCORE} AS score FROM folded""",
    "trust_history_daily": f"""{SOURCE_FOLD}
SELECT k AS source, ts, seq AS doc_id, round(trust, 6) AS trust, {SCORE} AS score FROM folded""",
    "trust_history_selected": f"""{VEHICLE_FOLD}
SELECT k AS user_id, ts, {SCORE} AS score FROM folded WHERE k <= {SELECTED_UP_TO}""",
    "source_report": f"""{SOURCE_FOLD}
SELECT k AS source, {SCORE} AS score FROM folded
QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1 ORDER BY source""",
    "event_gaps": f"""{VEHICLE_FOLD}
SELECT k AS user_id, seq AS event_id, round(gap, 6) AS gap_hours, round(decay, 6) AS decay FROM folded""",
    "score_reads": f"""{VEHICLE_FOLD},
newest AS (SELECT k, trust FROM folded QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
asked AS (SELECT s_suppkey AS user_id FROM supplier UNION SELECT c_custkey FROM customer)
SELECT a.user_id, CAST(round_even(coalesce(n.trust, 50.0), 0) AS INTEGER) AS score
FROM asked a LEFT JOIN newest n ON a.user_id = n.k""",
    "known_entity_events": """SELECT user_id, count(*) AS n_events FROM events
WHERE user_id IN (SELECT s_suppkey FROM supplier) GROUP BY user_id""",
    "unknown_entity_events": """SELECT user_id, count(*) AS n_events FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id""",
    "entity_accounts": """SELECT e.user_id, s.s_name, count(*) AS n_events,
  count(*) FILTER (e.event_type = 'error') AS n_errors
FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id GROUP BY e.user_id, s.s_name""",
    "missing_event_times": f"""WITH RECURSIVE {fold_ctes(UNTIMED_EVENTS.format(now=NOW), VEHICLE)}
SELECT k AS user_id, ts, seq AS event_id, round(trust, 6) AS trust, {SCORE} AS score FROM folded""",
    "citation_citers": f"""WITH {EDGES}
SELECT n.node, count(e.src) AS n_citations, count(DISTINCT e.src) AS n_citers
FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN edges e ON e.dst = n.node
GROUP BY n.node""",
    "citation_trust": f"WITH {trust_ctes()}\nSELECT node, round(trust, 6) AS trust FROM trust",
    "hybrid_verdicts": f"""WITH {LABELLED},
{nb_ctes('labelled', 'b')},
{nb_score_ctes('documents', 'b', 'skip', 'source')},
{trust_ctes()},
blended AS (
  SELECT s.doc_id, s.source, s.p_fake, coalesce(t.trust, 0.5) AS trust,
    0.7 * s.p_fake + 0.3 * (1 - coalesce(t.trust, 0.5)) AS final
  FROM scores s LEFT JOIN trust t ON s.source = 'src' || CAST(t.node + 5 AS VARCHAR))
SELECT doc_id, source, round(p_fake, 6) AS content_fake_score, round(trust, 6) AS source_trust_score,
  round(final, 6) AS final_fake_score, CASE WHEN final > 0.5 THEN 'fake' ELSE 'real' END AS verdict
FROM blended""",
}
