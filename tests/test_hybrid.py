"""The hybrid verdict on a small invented example, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sequential import propagate
from trustloom.functions.constants import STOP_B
from trustloom.functions.text import clean_b
from trustloom.operators.graph import citers, nodes_of, source_trust
from trustloom.operators.naive_bayes import NbModel, nb_fit, nb_score
from trustloom.plans.hybrid import hybrid

ARTICLES = [
    ("Miracle tea melts ten years away overnight", "fake"),
    ("Secret tunnel under the harbour hides giant robots", "fake"),
    ("Doctors furious about this miracle harbour trick", "fake"),
    ("Harbour ferry timetable changes from Monday", "real"),
    ("School board publishes budget for ten classrooms", "real"),
    ("Museum extends opening hours during the festival", "real"),
]
EDGES = [
    ("Hearsay", "Rumour"), ("Rumour", "Whisper"), ("Rumour", "Gossip"), ("Gazette", "Courier"), ("Gazette", "Herald"),
    ("Courier", "Herald"), ("Courier", "Chronicle"), ("Herald", "Courier"),
]
DECLARED = ["Whisper", "Chronicle", "Hermit"]
DIRECT = {"Courier": 0.92, "Herald": 0.81, "Gazette": 0.7, "Rumour": 0.15, "Hearsay": 0.3}
TRUST = propagate(EDGES, DIRECT, nodes=DECLARED)
CASES = [
    ("Museum budget published for the festival", "Courier"), ("Miracle robots hide secret trick", "Hearsay"),
    ("Miracle tea at the harbour", "Courier"), ("School board extends opening hours", "Rumour"), ("Nothing known", "Chronicle"),
    ("Secret tea tunnel", "Whisper"), ("Ferry timetable for the festival", "Stranger"), ("", "Hermit"),
]


def words(text):
    """Cleaner b by plain means: letters only, words of three letters and more that are no stop words."""
    cleaned = "".join(c for c in text.lower() if c.isalpha() or c == " ")
    return [w for w in cleaned.split() if len(w) > 2 and w not in STOP_B]


COUNTS = {c: Counter(w for text, label in ARTICLES if label == c for w in words(text)) for c in ("fake", "real")}
VOCABULARY = set(COUNTS["fake"]) | set(COUNTS["real"])


def fake_probability(text):
    """Naive Bayes with smoothing 1 over known words; the classes are equally frequent."""
    score = {
        c: sum(math.log((n[w] + 1) / (n.total() + len(VOCABULARY))) for w in words(text) if w in VOCABULARY)
        for c, n in COUNTS.items()}
    return 1 / (1 + math.exp(score["real"] - score["fake"]))


@pytest.fixture(scope="module")
def graph(spark):
    return (
        spark.createDataFrame(EDGES, "src string, dst string"),
        spark.createDataFrame(list(DIRECT.items()), "node string, direct double"),
        spark.createDataFrame([(n,) for n in DECLARED], "node string"),
    )


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(ARTICLES, "text string, label string")
    return nb_fit(docs.select("label", clean_b(F.col("text")).alias("tokens")))


def test_model_totals(model):
    t = model.totals
    assert (t.docs_fake, t.docs_real, t.vocab) == (3, 3, len(VOCABULARY))
    assert (t.tokens_fake, t.tokens_real) == (COUNTS["fake"].total(), COUNTS["real"].total())


@pytest.mark.parametrize("split_above", [1_000_000, 1])
def test_trust(graph, split_above):
    edges, direct, declared = graph
    trust = source_trust(edges, direct, declared=declared, split_above=split_above)
    got = {r.node: r.trust for r in trust.collect()}
    assert got == pytest.approx(TRUST, abs=1e-9)


def test_cases(spark, graph, model):
    edges, direct, declared = graph
    trust = source_trust(edges, direct, declared=declared, checkpoint_every=3)
    docs = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "doc_id int, text string, source string")
    tokens = docs.select("doc_id", "source", clean_b(F.col("text")).alias("tokens"))
    got = hybrid(tokens, model, trust).orderBy("doc_id").collect()
    assert {r.verdict for r in got} == {"fake", "real"}
    for r, (text, source) in zip(got, CASES, strict=True):
        p, trust = fake_probability(text), TRUST.get(source, 0.5)
        final = 0.7 * p + 0.3 * (1 - trust)
        assert r.content_fake_score == pytest.approx(p, abs=1e-9)
        assert r.source_trust_score == pytest.approx(trust, abs=1e-9)
        assert r.final_fake_score == pytest.approx(final, abs=1e-9)
        assert r.verdict == ("fake" if final > 0.5 else "real")
        assert r.result.asDict() == {c: r[c] for c in r.result.asDict()}


def test_trust_on_a_skewed_graph(spark):
    rng = random.Random(3)
    edges = [(0, rng.randrange(40)) for _ in range(300)] + [(rng.randrange(40), 1) for _ in range(300)]
    direct = {n: rng.random() for n in range(0, 60, 2)}
    want = propagate(edges, direct, nodes=(77,), iterations=4)
    trust = source_trust(
        spark.createDataFrame(edges, "src int, dst int"),
        spark.createDataFrame(list(direct.items()), "node int, direct double"),
        declared=spark.createDataFrame([(77,)], "node int"),
        iterations=4, checkpoint_every=2, split_above=7,
    )
    got = {r.node: r.trust for r in trust.collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert all(0 <= x <= 1 for x in got.values())


def test_nodes_and_citers(graph):
    edges, _, declared = graph
    assert {r.node for r in nodes_of(edges, declared).collect()} == set(TRUST)
    got = {r.node: (r.n_citations, r.n_citers) for r in citers(edges.union(edges.limit(1)), declared).collect()}
    assert got["Courier"] == (2, 2) and got["Gazette"] == (0, 0) and got["Rumour"] == (2, 1)


DOCS = [(1, ["secret", "budget", "zzz"]), (2, []), (3, ["zzz", "zzz"]), (4, ["museum", "miracle", "museum"])]


@pytest.mark.parametrize("unknown", ["count", "skip"])
def test_shuffled_tail_changes_nothing(spark, model, unknown):
    docs = spark.createDataFrame(DOCS, "doc_id int, tokens array<string>")
    whole = nb_score(docs, model, unknown=unknown).orderBy("doc_id").collect()
    cut = nb_score(docs, model, unknown=unknown, hot_rows=5).orderBy("doc_id").collect()
    assert len(whole) == len(DOCS)
    for a, b in zip(whole, cut, strict=True):
        assert (a.s_fake, a.s_real, a.verdict) == pytest.approx((b.s_fake, b.s_real, b.verdict))
    assert whole[1].verdict == "real" and whole[1].p_fake == 0.5


def test_model_survives_saving(spark, model, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id int, tokens array<string>")
    model.save(str(tmp_path / "m"))
    loaded = NbModel.load(spark, str(tmp_path / "m"))
    assert loaded.totals == model.totals
    assert sorted(nb_score(docs, loaded).collect()) == sorted(nb_score(docs, model).collect())


def test_edges_of_training(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, tokens array<string>")
    nothing = nb_fit(spark.createDataFrame([], "label string, tokens array<string>"))
    assert {(r.verdict, r.p_fake) for r in nb_score(docs, nothing).collect()} == {("real", 0.5)}
    one_class = nb_fit(spark.createDataFrame([("fake", ["secret"])], "label string, tokens array<string>"))
    assert {r.verdict for r in nb_score(docs, one_class).collect()} == {"fake"}
    with pytest.raises(ValueError, match="other than fake and real"):
        nb_fit(spark.createDataFrame([("satire", ["x"])], "label string, tokens array<string>"))
