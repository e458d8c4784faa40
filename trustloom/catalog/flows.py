"""Queries on scans, requests, the ledger and streams. Files are written from the driver tables first, whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trustloom.catalog.tables import (
    LABELLED,
    VEHICLE_FOLD,
    behaviour_events,
    documents,
    fold_ctes,
    labelled,
    nb_ctes,
    nb_score_ctes,
    table,
    with_tokens,
)
from trustloom.catalog.trust import SCORE, hourly
from trustloom.functions.constants import INVALID_BODY, SOURCE, TEXT_REQUIRED, TIMESTAMP_FORMAT, VEHICLE
from trustloom.operators.naive_bayes import nb_fit
from trustloom.operators.reputation import latest, trust_fold
from trustloom.session import materialise, scratch_path
from trustloom.sources.articles import article_events, submission_rows, write_events
from trustloom.sources.csv import read_behaviour, read_labelled, read_source_events
from trustloom.sources.ledger import Ledger
from trustloom.sources.requests import decode_requests, encode_reply
from trustloom.streaming.ledger import ledger_stream
from trustloom.streaming.scoring import score_texts, scoring_stream, submission_stream
from trustloom.streaming.trust import trust_history, trust_stream

# --- scans -----------------------------------------------------------------------------------------------------------


def _class_files(spark, sf_dir, docs):
    """One CSV folder per class, with the text in a column ``body``."""
    paths = {}
    for label in ("real", "fake"):
        paths[label] = scratch_path(spark, f"articles-{label}")
        rows = docs.where(F.col("label") == label).select("doc_id", F.col("text").alias("body"))
        rows.write.csv(paths[label], header=True, quote='"', escape='"', quoteAll=True)
    return paths


def _scanned(docs):
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "label", F.md5("text").alias("digest")
    )


def labelled_csv_scan(spark, sf_dir):
    paths = _class_files(spark, sf_dir, labelled(spark, sf_dir))
    return _scanned(read_labelled(spark, paths, text_col="body"))


def labelled_csv_scan_dropping(spark, sf_dir):
    """Texts of French documents are made empty; the scan drops them."""
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs = labelled(spark, sf_dir).join(lang, "doc_id")
    docs = docs.withColumn("text", F.when(F.col("lang") == "fr", "").otherwise(F.col("text")))
    paths = _class_files(spark, sf_dir, docs)
    return _scanned(read_labelled(spark, paths, text_col="body", drop_empty=True))


def _behaviour_records(spark, sf_dir):
    return behaviour_events(spark, sf_dir).select(
        F.date_format("ts", TIMESTAMP_FORMAT).alias("timestamp"), F.col("user_id").alias("vehicle_id"),
        F.col("good").cast("int").alias("behavior"), "event_id",
    )


def behaviour_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "behaviour")
    _behaviour_records(spark, sf_dir).drop("event_id").write.csv(path, header=True)
    return read_behaviour(spark, path).select("timestamp", "vehicle_id", "behavior")


def mixed_header_scan(spark, sf_dir):
    """Files of one folder with the columns in two orders, and a column that only some have."""
    path = scratch_path(spark, "mixed-behaviour")
    rows = _behaviour_records(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    rows.where(even).drop("event_id").write.mode("append").csv(path, header=True)
    rows.where(~even).withColumn("note", F.lit("x, y")).select("behavior", "note", "timestamp", "vehicle_id").write.mode(
        "append").csv(path, header=True)
    return read_behaviour(spark, path).select("timestamp", "vehicle_id", "behavior")


def csv_file_order(spark, sf_dir):
    """The events of each vehicle in the order of three files and of their lines."""
    path = scratch_path(spark, "ordered-behaviour")
    rows = _behaviour_records(spark, sf_dir).repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    rows.drop("event_id").write.csv(path, header=True)
    place = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("seq"))
    return read_behaviour(spark, path).select("vehicle_id", place.alias("place"), "timestamp", "behavior")


def _articles(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    published = F.timestamp_add("HOUR", F.col("doc_id") * 6, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return documents(spark, sf_dir).join(labels, "doc_id", "left").select(
        "source", F.concat(F.lit("Article "), F.col("doc_id").cast("string")).alias("title"), "text",
        published.alias("timestamp"), "label",
    )


def article_etl(spark, sf_dir):
    path = scratch_path(spark, "article-events")
    write_events(article_events(_articles(spark, sf_dir).where(F.col("label").isNotNull())), path)
    return spark.read.parquet(path).select(
        "source_id", "title", F.md5("text").alias("digest"), "prediction", "timestamp"
    )


def _event_file(spark, sf_dir):
    """Events as CSV; articles without a label have no number as prediction."""
    path = scratch_path(spark, "source-events")
    flag = F.coalesce(F.col("label").cast("string"), F.lit("unknown"))
    rows = _articles(spark, sf_dir).select(
        F.col("source").alias("source_id"), "title", "text", flag.alias("prediction"), "timestamp"
    )
    write_events(rows, path, fmt="csv")
    return path


def source_event_scan(spark, sf_dir):
    events, _ = read_source_events(spark, _event_file(spark, sf_dir))
    return events.select("source_id", "title", F.md5("text").alias("digest"), "prediction", "timestamp")


def source_event_quarantine(spark, sf_dir):
    _, quarantine = read_source_events(spark, _event_file(spark, sf_dir))
    return quarantine.select("source_id", "title", "reason")


def _submitted(spark, sf_dir):
    """(doc_id, source, verdict, prediction) of all documents, by a model of the labelled ones."""
    model = nb_fit(with_tokens(labelled(spark, sf_dir), "a"))
    return score_texts(documents(spark, sf_dir), model, id_col="doc_id", keep=("source",))


def submission_log(spark, sf_dir):
    path = scratch_path(spark, "submissions")
    # Texts are no grouping key: they come back by id.
    texts = documents(spark, sf_dir).select("doc_id", "text")
    scored = _submitted(spark, sf_dir).join(texts, "doc_id").withColumnRenamed("source", "source_id")
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    write_events(submission_rows(scored, now=now), path, mode="append")
    log = spark.read.parquet(path)
    return log.select("source_id", F.md5("text").alias("digest"), "prediction", "timestamp")


# --- requests --------------------------------------------------------------------------------------------------------


def _requests(spark, sf_dir):
    """Turns as request bodies: user turns well formed, assistant turns without text, others not JSON."""
    turns = table(spark, sf_dir, "conversations")
    body = (
        F.when(F.col("role") == "user", F.to_json(F.struct("text")))
        .when(F.col("turn") % 3 == 0, '{"text": ""}')
        .when(F.col("turn") % 3 == 1, '{"text": 7}')
        .otherwise(F.concat(F.lit("{"), F.col("text")))
    )
    request_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(request_id.alias("request_id"), body.alias("body"))


def _odd_requests(spark, sf_dir):
    """User turns under odd field names, repeated or beside other fields; other turns with a number before the text."""
    turns = table(spark, sf_dir, "conversations").withColumn("json", F.to_json(F.struct("text")))
    value = F.expr("substring(json, 9, length(json) - 9)")  # the text as a JSON string
    kind = F.when(F.col("role") == "user", F.col("turn") % 4).otherwise(4)
    body = F.element_at(F.array(
        F.concat(F.lit('{"Text":'), value, F.lit("}")),
        F.concat(F.lit('{"text":"first","TEXT":'), value, F.lit("}")),
        F.concat(F.lit('{"text":'), value, F.lit(',"text":null}')),
        F.concat(F.lit('{"more":{"text":1},"teXt":'), value, F.lit("}")),
        F.concat(F.lit('{"text":1,"text":'), value, F.lit("}")),
    ), (kind + 1).cast("int"))
    request_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(request_id.alias("request_id"), body.alias("body"))


def odd_request_validation(spark, sf_dir):
    decoded = decode_requests(_odd_requests(spark, sf_dir))
    return decoded.select("request_id", F.md5("text").alias("digest"), "reason")


def request_validation(spark, sf_dir):
    decoded = decode_requests(_requests(spark, sf_dir))
    return decoded.select("request_id", F.md5("text").alias("digest"), "reason")


def request_replies(spark, sf_dir):
    model = nb_fit(with_tokens(labelled(spark, sf_dir), "a"))
    valid = decode_requests(_requests(spark, sf_dir)).where(F.col("reason").isNull())
    scored = score_texts(valid, model, id_col="request_id")
    return scored.select("request_id", encode_reply(F.col("prediction")).alias("reply"))


# --- ledger ----------------------------------------------------------------------------------------------------------


def _ledger(spark, sf_dir):
    """Hourly trust written in two batches; scores after a bad event come from a writer that does not own the ledger."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"), "owner")
    writes = hourly(spark, sf_dir).select(
        F.col("user_id").alias("entity"), "score", "ts", F.col("event_id").alias("seq"),
        F.when(F.col("good"), "owner").otherwise("guest").alias("writer"),
    )
    middle = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    ledger.write(writes.where(F.col("ts") < middle), 0)
    ledger.write(writes.where(F.col("ts") >= middle), 1)
    return ledger


def ledger_latest(spark, sf_dir):
    return _ledger(spark, sf_dir).latest().select("entity", "score", "ts")


def ledger_reads(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    return _ledger(spark, sf_dir).read(keys)


def ledger_refusals(spark, sf_dir):
    return _ledger(spark, sf_dir).refused().select("entity", "seq", "reason")


def ledger_two_streams(spark, sf_dir):
    """Two streams write in turn, with batch numbers of their own; the first batch is then delivered again."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"), "owner")
    writes = materialise(hourly(spark, sf_dir).select(
        F.col("user_id").alias("entity"), "score", "ts", F.col("event_id").alias("seq"), F.lit("owner").alias("writer"),
    ), "writes")
    early = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    even = F.col("seq") % 2 == 0
    for rows, batch, stream in (
        (even & ~early, 7, "x"), (~even & ~early, 0, "y"), (even & early, 8, "x"), (~even & early, 1, "y"),
        (even & ~early, 7, "x"),
    ):
        ledger.write(writes.where(rows), batch, stream)
    return ledger.latest().select("entity", "score", "ts")


# --- streams ---------------------------------------------------------------------------------------------------------


def _in_thirds(spark, rows, ts, path, run):
    """Write ``rows`` by time in three parts, with a run of the stream after each: three starts on one checkpoint."""
    first, last = rows.agg(F.min(ts), F.max(ts)).first()
    third = (last - first) / 3
    cuts = [F.lit(first + third * i).cast("timestamp_ntz") for i in (1, 2)]
    for part in (F.col(ts) < cuts[0], (F.col(ts) >= cuts[0]) & (F.col(ts) < cuts[1]), F.col(ts) >= cuts[1]):
        rows.where(part).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def _in_parts(spark, rows, part, path, run):
    """The same with the parts 0, 1 and 2 of ``rows``."""
    for i in range(3):
        rows.where(part == i).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def _trust_stream_out(spark, sf_dir):
    base = scratch_path(spark, "trust-stream")
    events = behaviour_events(spark, sf_dir)
    _in_thirds(spark, events, "ts", f"{base}/in", lambda stream: trust_stream(
        stream, f"{base}/out", f"{base}/checkpoint",
        key="user_id", ts="ts", seq="event_id", good=F.col("good"), **VEHICLE,
    ))
    return f"{base}/out"


def stream_trust_history(spark, sf_dir):
    history = trust_history(spark, _trust_stream_out(spark, sf_dir), "user_id", "bigint")
    return history.select(
        "user_id", "ts", F.col("seq").alias("event_id"), F.round("trust", 6).alias("trust"), "score"
    )


def stream_ledger_latest(spark, sf_dir):
    out = _trust_stream_out(spark, sf_dir)
    history = trust_history(spark, out, "user_id", "bigint")
    stream = spark.readStream.schema(history.drop("batch").schema).parquet(f"{out}/history/batch=*")
    ledger = Ledger(spark, f"{out}/ledger", "owner")
    ledger_stream(stream, ledger, f"{out}/ledger-checkpoint", key="user_id").awaitTermination()
    return ledger.latest().select("entity", "score", "ts")


def stream_replies(spark, sf_dir):
    base = scratch_path(spark, "request-stream")
    requests = _requests(spark, sf_dir)
    model = nb_fit(with_tokens(labelled(spark, sf_dir), "a"))
    _in_parts(spark, requests, F.crc32("request_id") % 3, f"{base}/in", lambda stream: scoring_stream(
        stream, model, f"{base}/out", f"{base}/checkpoint", id_col="request_id"))
    replies = spark.read.parquet(f"{base}/out/replies").select("request_id", F.col("reply").alias("answer"))
    refused = spark.read.parquet(f"{base}/out/refused").select("request_id", F.col("reason").alias("answer"))
    return replies.unionByName(refused)


def stream_submission_trust(spark, sf_dir):
    """Documents submitted in the order of their time, scored, logged, and folded into the trust of their source."""
    base = scratch_path(spark, "submission-stream")
    submissions = _articles(spark, sf_dir).select(
        F.regexp_extract("title", r"(\d+)", 1).cast("bigint").alias("doc_id"), F.col("source").alias("source_id"),
        "text", "timestamp",
    )
    model = nb_fit(with_tokens(labelled(spark, sf_dir), "a"))

    def both(stream):
        submission_stream(stream, model, base, f"{base}/scoring", id_col="doc_id").awaitTermination()
        log = spark.read.parquet(f"{base}/log").drop("batch")
        logged = spark.readStream.schema(log.schema).parquet(f"{base}/log/batch=*")
        return trust_stream(
            logged, f"{base}/out", f"{base}/checkpoint",
            key="source_id", ts="timestamp", seq="doc_id", good=F.col("prediction") == 0, **SOURCE,
        )

    _in_thirds(spark, submissions, "timestamp", f"{base}/in", both)
    history = trust_history(spark, f"{base}/out", "source_id", "string")
    newest = latest(history, key="source_id", order=("ts", "seq"), values=("trust", "score"))
    return newest.select("source_id", F.round("trust", 6).alias("trust"), "score")


def batch_submission_trust(spark, sf_dir):
    """The same in one batch."""
    scored = _submitted(spark, sf_dir)
    published = F.timestamp_add("HOUR", F.col("doc_id") * 6, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    events = scored.select(F.col("source").alias("source_id"), published.alias("ts"), "doc_id", "prediction")
    folded = trust_fold(
        events, key="source_id", ts="ts", seq="doc_id", good=F.col("prediction") == 0, **SOURCE
    )
    newest = latest(folded, key="source_id", order=("ts", "doc_id"), values=("trust", "score"))
    return newest.select("source_id", F.round("trust", 6).alias("trust"), "score")


QUERIES = {
    "labelled_csv_scan": labelled_csv_scan,
    "labelled_csv_scan_dropping": labelled_csv_scan_dropping,
    "behaviour_csv_scan": behaviour_csv_scan,
    "mixed_header_scan": mixed_header_scan,
    "csv_file_order": csv_file_order,
    "article_etl": article_etl,
    "source_event_scan": source_event_scan,
    "source_event_quarantine": source_event_quarantine,
    "submission_log": submission_log,
    "request_validation": request_validation,
    "odd_request_validation": odd_request_validation,
    "request_replies": request_replies,
    "ledger_latest": ledger_latest,
    "ledger_reads": ledger_reads,
    "ledger_refusals": ledger_refusals,
    "ledger_two_streams": ledger_two_streams,
    "stream_trust_history": stream_trust_history,
    "stream_ledger_latest": stream_ledger_latest,
    "stream_replies": stream_replies,
    "stream_submission_trust": stream_submission_trust,
    "batch_submission_trust": batch_submission_trust,
}


# --- SQL -------------------------------------------------------------------------------------------------------------

_ARTICLES = """articles AS (
  SELECT d.doc_id, d.source, 'Article ' || d.doc_id AS title, d.text, 1 - l.quality AS label,
    TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id * 6 AS INTEGER)) AS timestamp
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_ARTICLE_ROWS = f"""WITH {_ARTICLES}
SELECT source AS source_id, title, md5(text) AS digest, CAST(label AS INTEGER) AS prediction, timestamp
FROM articles WHERE label IS NOT NULL"""

_TURNS = """turns AS (
  SELECT conv_id || '-' || turn AS request_id, text, role = 'user' AND text <> '' AS valid,
    CASE WHEN role = 'user' OR turn % 3 = 0 THEN '{required}' ELSE '{invalid}' END AS refusal
  FROM conversations)""".format(required=TEXT_REQUIRED.replace("'", "''"), invalid=INVALID_BODY)

_MODEL = f"{LABELLED},\n{nb_ctes('labelled', 'a')}"

_REPLIES = f"""WITH {_MODEL},
{_TURNS},
valid_turns AS (SELECT request_id AS doc_id, text FROM turns WHERE valid),
{nb_score_ctes('valid_turns', 'a', 'count')}"""

_REPLY = """CASE WHEN verdict = 'fake' THEN '{"is_fake":1}' ELSE '{"is_fake":0}' END"""

_SCORED_DOCS = f"{_MODEL},\n{nb_score_ctes('documents', 'a', 'count', 'source')}"

_SUBMISSION_FOLD = f"WITH RECURSIVE {_SCORED_DOCS},\n" + fold_ctes(
    """SELECT source AS k, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 6 AS INTEGER)) AS ts, doc_id AS seq,
    verdict = 'real' AS good FROM scores""",
    SOURCE,
)

_SUBMISSION_TRUST = f"""{_SUBMISSION_FOLD}
SELECT k AS source_id, round(trust, 6) AS trust, {SCORE} AS score FROM folded
QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1"""

_LEDGER = f"""{VEHICLE_FOLD},
owned AS (
  SELECT CAST(k AS VARCHAR) AS entity, {SCORE} AS score, ts FROM folded WHERE good
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)"""

_BEHAVIOUR_RECORDS = """SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp,
  CAST(user_id AS VARCHAR) AS vehicle_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS behavior FROM events"""

ORACLES = {
    "labelled_csv_scan": f"WITH {LABELLED}\nSELECT doc_id, label, md5(text) AS digest FROM labelled",
    "labelled_csv_scan_dropping": f"""WITH {LABELLED}
SELECT l.doc_id, l.label, md5(l.text) AS digest FROM labelled l JOIN documents d ON l.doc_id = d.doc_id
WHERE d.lang <> 'fr'""",
    "behaviour_csv_scan": _BEHAVIOUR_RECORDS,
    "mixed_header_scan": _BEHAVIOUR_RECORDS,
    "csv_file_order": """SELECT CAST(user_id AS VARCHAR) AS vehicle_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS place,
  CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS behavior FROM events""",
    "article_etl": _ARTICLE_ROWS,
    "source_event_scan": _ARTICLE_ROWS,
    "source_event_quarantine": f"""WITH {_ARTICLES}
SELECT source AS source_id, title, 'prediction is not a number' AS reason FROM articles WHERE label IS NULL""",
    "submission_log": f"""WITH {_SCORED_DOCS}
SELECT d.source AS source_id, md5(d.text) AS digest, CASE WHEN s.verdict = 'fake' THEN 1 ELSE 0 END AS prediction,
  TIMESTAMP '2024-06-01 12:00:00' AS timestamp FROM scores s JOIN documents d ON s.doc_id = d.doc_id""",
    "request_validation": f"""WITH {_TURNS}
SELECT request_id, CASE WHEN valid THEN md5(text) WHEN refusal LIKE '%required' THEN md5('') END AS digest,
  CASE WHEN NOT valid THEN refusal END AS reason FROM turns""",
    "odd_request_validation": f"""SELECT conv_id || '-' || turn AS request_id,
  CASE WHEN role = 'user' THEN md5(text) END AS digest,
  CASE WHEN role <> 'user' THEN '{INVALID_BODY}' WHEN text = '' THEN '{TEXT_REQUIRED.replace("'", "''")}' END AS reason
FROM conversations""",
    "request_replies": f"{_REPLIES}\nSELECT doc_id AS request_id, {_REPLY} AS reply FROM scores",
    "ledger_latest": f"{_LEDGER}\nSELECT entity, score, ts FROM owned",
    "ledger_reads": f"""{_LEDGER}
SELECT CAST(c.c_custkey AS VARCHAR) AS entity, coalesce(o.score, 0) AS score
FROM customer c LEFT JOIN owned o ON CAST(c.c_custkey AS VARCHAR) = o.entity""",
    "ledger_refusals": """SELECT CAST(user_id AS VARCHAR) AS entity, event_id AS seq,
  'only the owner can set a score' AS reason FROM events WHERE event_type = 'error'""",
    "ledger_two_streams": f"""{VEHICLE_FOLD},
commits AS (
  SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 2 ELSE 0 END + seq % 2 AS number FROM folded)
SELECT CAST(k AS VARCHAR) AS entity, {SCORE} AS score, ts FROM commits
QUALIFY row_number() OVER (PARTITION BY k ORDER BY number DESC, i DESC) = 1""",
    "stream_trust_history": f"""{VEHICLE_FOLD}
SELECT k AS user_id, ts, seq AS event_id, round(trust, 6) AS trust, {SCORE} AS score FROM folded""",
    "stream_ledger_latest": f"""{VEHICLE_FOLD}
SELECT CAST(k AS VARCHAR) AS entity, {SCORE} AS score, ts FROM folded
QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1""",
    "stream_replies": f"""{_REPLIES}
SELECT doc_id AS request_id, {_REPLY} AS answer FROM scores
UNION ALL SELECT request_id, refusal FROM turns WHERE NOT valid""",
    "stream_submission_trust": _SUBMISSION_TRUST,
    "batch_submission_trust": _SUBMISSION_TRUST,
}
