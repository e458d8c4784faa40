import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trustloom.functions.constants import INVALID_BODY, TEXT_REQUIRED
from trustloom.sources.articles import article_events, submission_rows, write_events
from trustloom.sources.csv import read_behaviour, read_labelled, read_source_events
from trustloom.sources.ledger import Ledger
from trustloom.sources.parquet import spread_small
from trustloom.sources.requests import decode_requests, encode_reply

def now():
    return F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")



@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def test_labelled_files(spark, put):
    real = put("real.csv", 'title,body\nx,"two\nlines, ""quoted"""\ny,\nz,NA\n')
    fake = put("fake.csv", 'body,extra\nfalse,1\n')
    kept = read_labelled(spark, {"real": real, "fake": fake}, text_col="body")
    got = {(r.label, r.text) for r in kept.collect()}
    assert got == {("real", 'two\nlines, "quoted"'), ("real", ""), ("real", "NA"), ("fake", "false")}
    assert set(kept.columns) == {"title", "text", "label", "extra"}
    dropped = read_labelled(spark, {"real": real, "fake": fake}, text_col="body", drop_empty=True)
    assert {(r.label, r.text) for r in dropped.collect()} == {("real", 'two\nlines, "quoted"'), ("fake", "false")}


def test_labelled_file_errors(spark, put):
    with pytest.raises(ValueError, match="not found"):
        read_labelled(spark, {"real": put("a.csv", "title\nx\n")})
    short = put("b.csv", "title,text\nx,y\nz\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_labelled(spark, {"real": short}).select("label").collect()
    with pytest.raises(ValueError, match="no valid data"):
        read_labelled(spark, {"real": put("c.csv", "title,text\nx,\n")}, drop_empty=True)


def test_behaviour_file(spark, put):
    path = put("v.csv", "vehicle_id,behavior,timestamp\n007,1,2025-05-01 00:02:00\n8,0,2025-05-01 00:00:00\n")
    rows = read_behaviour(spark, path).orderBy("timestamp", "seq").collect()
    assert [(r.vehicle_id, r.behavior) for r in rows] == [("8", 0), ("007", 1)]
    assert rows[0].timestamp == dt.datetime(2025, 5, 1)
    for bad in ("7,x,2025-05-01 00:02:00", "7,1,2025/05/01", "7,1"):
        broken = put("w.csv", f"vehicle_id,behavior,timestamp\n{bad}\n")
        with pytest.raises(Exception):
            read_behaviour(spark, broken).collect()


def test_source_event_file(spark, put):
    path = put("s.csv", "source_id,title,text,prediction,timestamp\n"
                        "a,t,x,1,2025-01-01T10:00:00\n"
                        "a,t,x,maybe,2025-01-01T10:00:00\n"
                        "b,long text,0,2025-01-01T10:00:00\n"
                        "b,t,x,0,yesterday\n"
                        "c,t,\"multi\nline\",0,2025-01-01T11:00:00.5\n")
    events, quarantine = read_source_events(spark, path)
    assert [(r.source_id, r.prediction, r.timestamp) for r in events.orderBy("seq").collect()] == [
        ("a", 1, dt.datetime(2025, 1, 1, 10)), ("c", 0, dt.datetime(2025, 1, 1, 11, 0, 0, 500000)),
    ]
    assert [r.reason for r in quarantine.orderBy("seq").collect()] == [
        "prediction is not a number", "fields do not fit the header", "timestamp is not a time",
    ]


def test_source_events_without_time_or_file(spark, put, tmp_path):
    events, _ = read_source_events(spark, put("n.csv", "source_id,prediction\na,1\n"), now=now())
    assert events.first().timestamp == dt.datetime(2025, 1, 2, 3, 4, 5)
    none, bad = read_source_events(spark, str(tmp_path / "absent.csv"))
    assert none.count() == 0 and bad.count() == 0


def test_article_events_round_trip(spark, tmp_path):
    schema = "source string, title string, text string, timestamp timestamp_ntz, label string"
    rows = [("a", 'say "hi"', "x\ny", dt.datetime(2025, 1, 1, 1, 2, 3, 456789), "1")]
    articles = spark.createDataFrame(rows, schema)
    events = article_events(articles)
    assert events.first().prediction == 1
    assert article_events(articles.withColumnRenamed("label", "prediction")).first().prediction == 1
    both = articles.withColumn("prediction", F.lit("0"))
    assert article_events(both).first().prediction == 1
    for fmt in ("parquet", "csv"):
        write_events(events, str(tmp_path / fmt), fmt=fmt)
    back, bad = read_source_events(spark, str(tmp_path / "csv"))
    assert back.drop("seq").collect() == events.collect() == spark.read.parquet(str(tmp_path / "parquet")).collect()
    assert bad.count() == 0
    with pytest.raises(Exception):
        article_events(articles.withColumn("label", F.lit("maybe"))).collect()


def test_submissions(spark):
    scored = spark.createDataFrame([("a", "x", 1), ("b", "y", -1), ("c", "z", None)], "source_id string, text string, prediction int")
    rows = submission_rows(scored, now=now()).collect()
    assert [(r.source_id, r.prediction, r.timestamp) for r in rows] == [("a", 1, dt.datetime(2025, 1, 2, 3, 4, 5))]


@pytest.mark.parametrize("body,text,reason", [
    ('{"text": "hello"}', "hello", None),
    ('{"text": "a", "more": [1]}', "a", None),
    ('{"text": ""}', "", TEXT_REQUIRED),
    ("{}", None, TEXT_REQUIRED),
    ('{"text": null}', None, TEXT_REQUIRED),
    ("null", None, TEXT_REQUIRED),
    ('{"text": 5}', None, INVALID_BODY),
    ("[1]", None, INVALID_BODY),
    ("{text", None, INVALID_BODY),
    ("", None, INVALID_BODY),
    (None, None, INVALID_BODY),
    ('{"Text": "hello"}', "hello", None),
    ('{"text": "a", "TEXT": "b"}', "b", None),
    ('{"text": "a", "text": "b", "text": null}', "b", None),
    ('{"text": 1, "text": "b"}', None, INVALID_BODY),
    ('{"text": "a", "text": ""}', "", TEXT_REQUIRED),
    ('{"text": "a"} and more', "a", None),
    ('{"more": {"text": 5}, "text": "é \\" q"}', 'é " q', None),
])
def test_requests(spark, body, text, reason):
    row = decode_requests(spark.createDataFrame([(body,)], "body string")).first()
    assert (row.text, row.reason) == (text, reason)


def test_reply(spark):
    assert json.loads(spark.range(1).select(encode_reply(F.lit(1))).first()[0]) == {"is_fake": 1}


SCORES = "entity string, score int, ts timestamp_ntz, seq long, writer string"


def test_ledger(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    later = at + dt.timedelta(hours=1)
    ledger = Ledger(spark, str(tmp_path / "ledger"), "me")
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "entity string")
    assert {r.score for r in ledger.read(keys).collect()} == {0}
    ledger.write(spark.createDataFrame([
        ("a", 1, at, 1, "me"), ("a", 2, later, 2, "me"), ("b", 9, at, 3, "you"), ("b", -1, at, 4, "me"),
        ("b", 5, at, 5, None),
    ], SCORES), 0)
    second = spark.createDataFrame([("a", 7, at, 6, "me"), ("b", 3, at, 7, "me")], SCORES)
    for _ in range(2):
        ledger.write(second, 1)
    assert {(r.entity, r.score) for r in ledger.latest().collect()} == {("a", 7), ("b", 3)}
    assert {(r.entity, r.score) for r in ledger.read(keys).collect()} == {("a", 7), ("b", 3), ("z", 0)}
    assert ledger.history().count() == 3
    assert sorted((r.seq, r.reason) for r in ledger.refused().collect()) == [
        (3, "only the owner can set a score"), (4, "score must not be negative"), (5, "only the owner can set a score"),
    ]
    compacted = ledger.compact(str(tmp_path / "compact"))
    assert compacted.history().count() == 2
    assert {(r.entity, r.score) for r in compacted.latest().collect()} == {("a", 7), ("b", 3)}
    compacted.write(spark.createDataFrame([("c", 4, at, 8, "me"), ("a", 1, at, 9, "me")], SCORES), 0)
    compacted.write(spark.createDataFrame([("d", 6, at, 8, "me")], SCORES), 0, "other")
    assert {(r.entity, r.score) for r in compacted.latest().collect()} == {("a", 1), ("b", 3), ("c", 4), ("d", 6)}


def test_columns_are_found_by_the_header_of_each_file(spark, tmp_path):
    folder = tmp_path / "mixed files"
    folder.mkdir()
    (folder / "a.csv").write_text("title,text\nT1,\"X1\nmore\"\n")
    (folder / "b.csv").write_text("text,title,extra\nX2,T2,e\n")
    (folder / "c.csv").write_text("text,title,extra\n")
    got = read_labelled(spark, {"real": str(folder)}).collect()
    assert {(r.title, r.text, r.extra, r.label) for r in got} == {("T1", "X1\nmore", None, "real"), ("T2", "X2", "e", "real")}
    (folder / "d.csv").write_text("body,title\nX3,T3\n")
    with pytest.raises(ValueError, match="not found"):
        read_labelled(spark, {"real": str(folder)})


def test_events_of_several_files_and_headers(spark, tmp_path):
    for name, text in (
        ("1.csv", "timestamp,vehicle_id,behavior\n2025-05-01 00:00:00,a,1\n2025-05-01 00:00:00,a,0\n"),
        ("2.csv", "vehicle_id,behavior,timestamp\na,1,2025-05-01 00:00:00\n" + "b,1,2025-05-01 00:00:00\n" * 50),
        ("3.csv", "timestamp,vehicle_id,behavior\n2025-05-01 00:00:00,a,0\n2025-05-01 00:00:00,a,0\n"),
    ):
        (tmp_path / name).write_text(text)
    rows = read_behaviour(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.behavior for r in rows if r.vehicle_id == "a"] == [1, 0, 1, 0, 0]
    assert [r.vehicle_id for r in rows] == ["a"] * 3 + ["b"] * 50 + ["a"] * 2 and len({r.seq for r in rows}) == 55
    for name, text in (
        ("1.csv", "source_id,prediction,timestamp\na,1,2025-01-01T10:00:00\n"),
        ("2.csv", "prediction,source_id\n0,b\nx,c\n0,d,e\n"),
    ):
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / name).write_text(text)
    events, bad = read_source_events(spark, str(tmp_path / "s"), now=now())
    assert [(r.source_id, r.prediction, r.timestamp) for r in events.orderBy("seq").collect()] == [
        ("a", 1, dt.datetime(2025, 1, 1, 10)), ("b", 0, dt.datetime(2025, 1, 2, 3, 4, 5))]
    assert [r.reason for r in bad.orderBy("seq").collect()] == ["prediction is not a number", "fields do not fit the header"]


def test_ledger_orders_the_writes_of_all_streams(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), "me")
    january, february = dt.datetime(2025, 1, 5), dt.datetime(2025, 2, 5)
    ledger.write(spark.createDataFrame([("a", 10, january, 1, "me"), ("b", 5, january, 2, "you")], SCORES), 7, "x")
    ledger.write(spark.createDataFrame([("a", 99, february, 3, "me")], SCORES), 0, "y")
    ledger.write(spark.createDataFrame([("a", 10, january, 1, "me"), ("b", 5, january, 2, "you")], SCORES), 7, "x")
    assert ledger.latest().first().score == 99
    assert sorted((r.number, r.stream, r.batch) for r in ledger.commits().collect()) == [(0, "x", 7), (1, "y", 0)]
    assert ledger.refused().count() == 1 and ledger.history().count() == 2


def test_a_killed_write_is_not_seen(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"), "me")
    at = dt.datetime(2025, 1, 5)
    ledger.write(spark.createDataFrame([("a", 10, at, 1, "me")], SCORES), 0)

    def killed(*_):
        raise KeyboardInterrupt

    again = spark.createDataFrame([("a", 20, at, 2, "me"), ("b", 1, at, 2, "you")], SCORES)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_number", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.write(again, 1)
    assert ledger.latest().first().score == 10 and ledger.refused().count() == 0
    ledger.write(again, 1)
    assert ledger.latest().first().score == 20 and ledger.refused().count() == 1


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / p)) for p in ("one", "many"))
    assert spread_small(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_small(many, "id") is many
