import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sequential import fold
from trustloom.functions.constants import SOURCE, VEHICLE
from trustloom.operators.naive_bayes import nb_fit
from trustloom.sources.ledger import Ledger
from trustloom.streaming.ledger import ledger_stream
from trustloom.streaming.scoring import scoring_stream, submission_stream
from trustloom.streaming.trust import trust_history, trust_stream

EVENTS = "entity string, at timestamp_ntz, n bigint, good boolean"
START = dt.datetime(2024, 1, 1)


def run(spark, base, rows, **more):
    """Add ``rows`` to the input and let the stream catch up."""
    spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{base}/in")
    trust_stream(
        stream, f"{base}/out", f"{base}/checkpoint", key="entity", ts="at", seq="n", good=F.col("good"), **VEHICLE, **more
    ).awaitTermination()


def history(spark, base):
    return trust_history(spark, f"{base}/out", "entity", "string")


@pytest.mark.parametrize("more", [{}, {"full_every": 2, "slice_rows": 20}])
def test_batches_equal_one_fold(spark, tmp_path, more):
    rng = random.Random(4)
    rows = [
        ("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", START + dt.timedelta(minutes=7 * i), i, rng.random() < 0.6)
        for i in range(250)
    ]
    for i in range(0, 250, 50):
        run(spark, tmp_path, rows[i : i + 50], **more)
    want = fold(rows, unit_seconds=3600, rate=0.1, reward=0.1, keep=0.5)
    got = history(spark, tmp_path).collect()
    assert len({r.batch for r in got}) == 5 and len(got) == len(rows)
    for r in got:
        assert r.trust == pytest.approx(want[(r.entity, r.seq)], abs=1e-9)


def test_late_and_repeated_events_are_set_aside(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    run(spark, tmp_path, [("a", START + 2 * hour, 5, True), ("b", START, 1, True)])
    run(spark, tmp_path, [
        ("a", START + hour, 6, False),      # before the last one of a
        ("a", START + 2 * hour, 5, True),   # the last one again
        ("a", START + 2 * hour, 7, False),  # same time, later in order
        ("c", START, 8, True),              # new key, old time
    ])
    late = spark.read.parquet(f"{tmp_path}/out/late")
    assert sorted(r.seq for r in late.collect()) == [5, 6]
    trust = {r.seq: r.trust for r in history(spark, tmp_path).collect()}
    assert trust == pytest.approx({5: 55.0, 1: 55.0, 7: 27.5, 8: 55.0})


def test_scores_reach_the_ledger(spark, tmp_path):
    rows = [(f"k{i % 3}", START + dt.timedelta(hours=i), i, i % 4 != 0) for i in range(20)]
    ledger = Ledger(spark, f"{tmp_path}/ledger", "me")
    for part in (rows[:8], rows[8:]):
        run(spark, tmp_path, part)
        schema = history(spark, tmp_path).drop("batch").schema
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/out/history/batch=*")
        ledger_stream(stream, ledger, f"{tmp_path}/ledger-checkpoint", key="entity").awaitTermination()
    newest = {}
    for (key, seq), x in sorted(fold(rows, unit_seconds=3600, rate=0.1, reward=0.1, keep=0.5).items(), key=lambda e: e[0][1]):
        newest[key] = round(x)
    assert {r.entity: r.score for r in ledger.latest().collect()} == newest
    assert ledger.history().count() == 6


@pytest.fixture(scope="module")
def model(spark):
    docs = [("fake", ["secret", "miracle"]), ("real", ["council", "budget"])]
    return nb_fit(spark.createDataFrame(docs, "label string, tokens array<string>"))


def test_replies(spark, tmp_path, model):
    bodies = ['{"text": "A secret miracle!"}', '{"text": "council budget"}', '{"text": ""}', "oops"]
    schema = "id int, body string"
    for i, body in enumerate(bodies):
        spark.createDataFrame([(i, body)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        scoring_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/cp", id_col="id").awaitTermination()
    replies = {r.id: r.reply for r in spark.read.parquet(f"{tmp_path}/out/replies").collect()}
    assert replies == {0: '{"is_fake":1}', 1: '{"is_fake":0}'}
    refused = {r.id for r in spark.read.parquet(f"{tmp_path}/out/refused").collect()}
    assert refused == {2, 3}


def test_submissions_feed_trust(spark, tmp_path, model):
    schema = "id bigint, source_id string, text string, timestamp timestamp_ntz"
    texts = ["council budget", "secret miracle", "", "council"]
    rows = [(i, "src", text, START + dt.timedelta(days=i)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    submission_stream(stream, model, str(tmp_path), f"{tmp_path}/scoring", id_col="id").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log").drop("batch")
    assert {(r.id, r.prediction) for r in log.collect()} == {(0, 0), (1, 1), (3, 0)}
    trust_stream(
        spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log/batch=*"), f"{tmp_path}/out", f"{tmp_path}/cp",
        key="source_id", ts="timestamp", seq="id", good=F.col("prediction") == 0, **SOURCE,
    ).awaitTermination()
    events = [("src", START + dt.timedelta(days=i), i, i != 1) for i in (0, 1, 3)]
    want = fold(events, unit_seconds=86400, rate=0.05, reward=0.1, keep=0.8)
    got = trust_history(spark, f"{tmp_path}/out", "source_id", "string").collect()
    assert {("src", r.seq): r.trust for r in got} == pytest.approx(want)
