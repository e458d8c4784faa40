"""Top-k search, WARC archives, the components, the queries and the pipeline."""

import base64
import glob
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import connect, difference, duck_result, spark_result
from trustloom.llm import bpe, components, quality, registry, topk, warc
from trustloom.llm.line_dedup import line_dedup
from trustloom.llm.near_dedup import near_duplicates

SF_DIR = "/root/testdata/sf0.001"


# ---- top k


def test_top_k_equals_sort(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-9, 10, 12).tolist() for i in range(300)}
    vectors[301], vectors[302] = vectors[5], vectors[5]  # ties
    rows = [(i, v, "x") for i, v in vectors.items()] + [(400, None, "x"), (420, [1, None] * 6, "x"), (None, [1] * 12, "x")]
    rows += [(440, [1, 2], "x"), (460, [], "x"), (480, [3, 4], "x"), (7, vectors[7], "again")]
    rows += [(40, rng.integers(-9, 10, 12).tolist(), "other"), (9, [9] * 12, "other"), (9, [-9] * 12, "other")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>, score string")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=5, candidates_at_once=50, queries_at_once=4)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    usable = [(i, v) for i, v, _ in rows if i is not None and v and None not in v]
    for q in {i for i, _ in usable if i % 20 == 0}:
        others = [
            (i, int(np.dot(v, w))) for i, v in usable for j, w in usable if j == q and i != q and len(v) == len(w)]
        assert found.pop(q) == sorted(others, key=lambda x: (-x[1], x[0]))[:7]
    assert not found
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_repeated_vectors_as_in_sql(spark, tmp_path):
    rows = [(1, [1.0, 1.0]), (1, [3.0, 3.0]), (20, [1.0, 2.0]), (20, [0.5, -1.0]), (2, [1.0, 0.0])] + [(7, [0.25, 0.25])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = spark_result(topk.top_k(topk.whole_numbers(df), F.col("vec_id") % 20 == 0, candidates_at_once=4, queries_at_once=1))
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    assert difference(got, duck_result(con, registry.ORACLES["op4_topk"])) is None
    assert got[1]


def test_whole_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.01]), (2, [inf, 0.0]), (3, [nan, 0.0]), (4, [None, 0.0]), (5, None), (6, [])]
    got = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    assert [r.embedding for r in got] == [[32, -1], None, None, None, None, []]


# ---- archives


PAGES = "page_id long, url string, html string, key string, part int"


def pages(spark):
    rnd = random.Random(2)
    rows = [(i, f"http://x/{i}", rnd.choice(["same", "", f"<p>page {i} é\r\n\r\n</p>", None]), "k", 1) for i in range(120)]
    rows += [(500, None, "x" * 300_000, None, None), (501, "http://a\r\nWARC-Type: x", "no url", "k", 1), (None, "u", "same", "k", 1)]
    return spark.createDataFrame(rows + [(600, "u", "twice", "k", 1)] * 2, PAGES)


def test_archives_hold_the_pages(spark, tmp_path):
    df, path = pages(spark), str(tmp_path / "warc")
    listed = warc.write_warc(df, path, roll_bytes=4000).collect()
    got = warc.read_warc(spark, path).collect()
    rows, largest = df.collect(), {}
    for r in rows:
        if r.page_id is not None:  # a page without id is never what others revisit
            largest[r.html or ""] = max(largest.get(r.html or "", -1), r.page_id)
    want = Counter()
    for r in rows:
        body = (r.html or "").encode()
        to = largest.get(r.html or "") if largest.get(r.html or "") != r.page_id else None
        want[(r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to)] += 1
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    text = {r.page_id: r.html or "" for r in rows}
    assert all(r.payload == text[r.key] for r in got if r.record_type == "response")
    files = sorted(glob.glob(f"{path}/*.warc.gz"))
    assert len(files) == len(listed) > 3 and sum(r.records for r in listed) == len(rows)
    assert b"".join(gzip.open(f).read() for f in files).count(b"WARC/1.1\r\n") == len(rows)
    assert not glob.glob(f"{path}/_temporary*") and not glob.glob(f"{path}/*.tmp")


def test_archives_of_a_crowd_without_id(spark, tmp_path):
    rows = [(None, f"u{i % 3}", "", "k", 1) for i in range(3_000)] + [(i, "v", "", "k", 1) for i in range(40)]
    rows += [(None, "w", "alone", "k", 1)] * 1_500 + [(7, "u", "x", "k", 1)] * 2
    df, path = spark.createDataFrame(rows, PAGES).repartition(6), str(tmp_path / "warc")
    warc.write_warc(df, path, roll_bytes=30_000)
    got = Counter((r.key, r.payload_bytes, r.refers_to) for r in warc.read_warc(spark, path).collect())
    assert got == Counter({(None, 0, 39): 3_000, (39, 0, None): 1, **{(i, 0, 39): 1 for i in range(39)},
                           (None, 5, None): 1_500, (7, 1, None): 2})


def test_archives_do_not_depend_on_partitions(spark, tmp_path):
    bytes_of = []
    for name, n in (("a", 3), ("b", 11), ("b", 5)):
        warc.write_warc(pages(spark).repartition(n), str(tmp_path / name), roll_bytes=4000)
        bytes_of.append([open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / name / "*.warc.gz")))])
    assert bytes_of[0] == bytes_of[1] == bytes_of[2]


def test_small_payloads_and_no_pages(spark, tmp_path):
    warc.write_warc(pages(spark), str(tmp_path / "a"), least_revisit=5)
    got = warc.read_warc(spark, str(tmp_path / "a"))
    assert got.where("payload_bytes < 5 AND record_type = 'revisit'").count() == 0
    warc.write_warc(pages(spark).limit(0), str(tmp_path / "b"))
    assert warc.read_warc(spark, str(tmp_path / "b")).count() == 0


def test_broken_records_are_found():
    good = warc.record(1, "u", b"body", None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(good)[1] == b"body"
    for bad in (good.replace(b"body", b"bodx"), good[:-1], b"x" + good):
        with pytest.raises((ValueError, KeyError)):
            warc.parse_record(bad)


# ---- components


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    edges += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)] + [(5, 5), (-3, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {x: find(x) for x in parent}


# ---- queries


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = spark_result(registry.QUERIES[name](spark, SF_DIR))
    assert got[1] and difference(got, duck_result(duck, registry.ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_returns_a_row_per_row(spark, name):
    source = "pages" if name.startswith("op5") else "documents"
    assert registry.QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()


def test_held_out_accuracy(spark):
    found = registry.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = registry.QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


# ---- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    after = {"documents": docs}
    for (name, stage), before in zip(corpus_pipeline.STAGES, ["documents", *(n for n, _ in corpus_pipeline.STAGES)]):
        after[name] = stage(spark, after[before], SF_DIR).cache()
    ids = {name: [r.doc_id for r in df.collect()] for name, df in after.items()}
    for name in ("quality", "line_dedup", "near_dedup", "decontaminate"):
        assert after[name].columns == docs.columns

    scored = quality.score_quality(docs, quality.fit_on(spark, docs, SF_DIR)).collect()
    assert sorted(ids["quality"]) == sorted(r.doc_id for r in scored if r.score >= 0.3)
    texts = {r.doc_id: r.text for r in after["line_dedup"].collect()}
    cleaned = line_dedup(after["quality"], distinct_pages=True, min_pages=2)
    assert texts == {r.doc_id: r.text for r in cleaned.collect()}
    classes = near_duplicates(after["line_dedup"]).collect()
    assert sorted(ids["near_dedup"]) == sorted({r.class_id for r in classes})

    con = duckdb.connect()
    con.register("documents", after["near_dedup"].toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF_DIR}/benchmark.parquet')")
    bad = {r[0] for r in con.execute(
        f"SELECT doc_id FROM ({registry.ORACLES['op2_decontaminate']}) WHERE contaminated").fetchall()}
    assert sorted(ids["decontaminate"]) == sorted(set(ids["near_dedup"]) - bad)

    encoder = bpe.Encoder(bpe.Vocabulary(open(bpe.tokenizer_path(), encoding="utf-8").read()))
    for r in after["encode"].collect():
        assert r.n_tokens == len(r.ids)
        assert r.ids == encoder.encode([texts[r.doc_id]])[0].tolist()
    assert sorted(ids["encode"]) == sorted(ids["decontaminate"])


def test_pipeline_odd_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None)]
    rows += [(3, "", "en", "s", 0), (None, "some words here", "en", None, 15), (4, "x " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF_DIR)
        assert name == "encode" or got.columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
        if name == "near_dedup":
            assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 3, 4]
        elif name != "quality":
            assert got.count() == docs.count()


def test_pipeline_leaves_other_columns_alone(spark):
    schema = "doc_id long, text string, lang string, source string, n_lines int, n_dropped int, `a.b` int, row string"
    rows = [(i, f"menu\npage {i} says this", "en", "s", 777, 778, i, "r") for i in range(6)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF_DIR)
        assert got.columns == docs.columns
        assert all((r.n_lines, r.n_dropped, r["a.b"], r.row) == (777, 778, r.doc_id, "r") for r in got.collect())
        if name == "line_dedup":
            assert sorted(r.text for r in got.collect()) == [f"page {i} says this" for i in range(6)]


def test_pipeline_keeps_one_of_many_copies(spark):
    rnd = random.Random(23)
    page = lambda i: "\n".join(f"line {i} {j} " + " ".join(f"w{rnd.randrange(5_000)}" for _ in range(12)) for j in range(5))
    copied = page("copy")
    rows = [(i, copied, "en", "s", len(copied)) for i in range(20)]
    rows += [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(f"menu\n{page(i)}" for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.line_dedup(spark, docs, SF_DIR).cache()
    assert all(r.text == copied and r.n_chars == len(copied) for r in cleaned.where("doc_id < 100").collect())
    assert not any("menu" in r.text for r in cleaned.collect())
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, cleaned, SF_DIR).collect()}
    assert {i: t for i, t in kept.items() if i < 100} == {0: copied} and len(kept) == 41


def test_pipeline_decontaminates_by_id_and_text(spark):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where(F.length("text") > 0)
    leak = items.orderBy(F.desc(F.length("text"))).first().text
    texts = [(None, leak), (None, "a clean one"), (None, None), (7, f"so {leak}"), (7, "another clean one"), (-1, "clean too")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontaminate(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == set(texts) - {texts[0], texts[3]}
