import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustloom.functions.digests import Heads
from trustloom.operators import lookup
from trustloom.operators import vectors as vectors_module
from trustloom.operators import vocabulary as vocabulary_module
from trustloom.operators.lemmas import lemma_table, lemmatise
from trustloom.operators.linear import INTERCEPT, logistic_fit, logistic_score
from trustloom.operators.metrics import evaluate
from trustloom.operators.naive_bayes import nb_fit_weighted, nb_score_weighted
from trustloom.operators.split import allot_test, split_prefix, split_stratified
from trustloom.operators.tfidf import tfidf_fit, tfidf_transform
from trustloom.operators.vectors import doc_vectors, nearest, prototypes, word_vectors
from trustloom.operators.vocabulary import (
    dense_ids,
    negative_pairs,
    padded_sequences,
    sequence_vocabulary,
    skipgrams,
    training_pairs,
    vocabulary,
    word_ids,
)


def corpus(n=60, seed=5, words=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = "fake" if rng.random() < 0.4 else "real"
        pool = [f"w{min(int(rng.expovariate(0.15)), words)}" for _ in range(rng.randrange(25))]
        rows.append((i, label, pool + (["tell"] if label == "fake" and rng.random() < 0.8 else [])))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id int, label string, tokens array<string>").persist()


def digest(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 10, 5000])
def test_prefix_split(spark, n):
    got = {r.id: r.fold for r in split_prefix(spark.range(n), id_col="id", train=0.8, seed=7).collect()}
    ordered = sorted(range(n), key=lambda i: digest(7, i))
    assert {i for i, f in got.items() if f == "train"} == set(ordered[: math.floor(n * 0.8)])


def test_stratified_split(spark):
    labels = ["fake" if i % 7 == 0 else "real" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    got = {r.id: r.fold for r in split_stratified(df, id_col="id").collect()}
    want = allot_test(Counter(labels), 0.25)
    assert sum(want.values()) == math.ceil(0.25 * 3000)
    for label, k in want.items():
        ordered = sorted((i for i, x in enumerate(labels) if x == label), key=lambda i: digest(42, i))
        assert {i for i in ordered if got[i] == "test"} == set(ordered[:k])


def test_split_falls_back_without_classes(spark):
    df = spark.createDataFrame([(i, "fake" if i == 0 else "real") for i in range(10)], "id int, label string")
    got = split_stratified(df, id_col="id").groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in got} == {"test": 3, "train": 7}
    assert allot_test({"fake": 1, "real": 9}, 0.25) is None


def test_metrics(spark):
    pairs = [("fake", "fake")] * 3 + [("real", "fake")] * 2 + [("fake", "real")] + [("real", "real")] * 4
    m = evaluate(spark.createDataFrame(pairs, "label string, verdict string")).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 2, 1, 4)
    assert (m.accuracy, m.precision, m.recall) == pytest.approx((0.7, 0.6, 0.75))
    assert m.f1 == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    none = evaluate(spark.createDataFrame([], "label string, verdict string")).first()
    assert none.accuracy is None and none.precision == none.recall == none.f1 == 0.0


def test_dense_ids(spark):
    rng = random.Random(1)
    counts = [(f"t{i}", rng.choice([1, 1, 1, 2, 5])) for i in range(2000)]
    got = {r.w: r.id for r in dense_ids(spark.createDataFrame(counts, "w string, n long"), key="w", count="n").collect()}
    ordered = sorted(counts, key=lambda c: (-c[1], hashlib.md5(c[0].encode()).hexdigest()))
    assert got == {w: i for i, (w, _) in enumerate(ordered, start=1)}


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_word_ids_and_pairs(docs, hot_rows):
    vocab = vocabulary(docs, min_count=2)
    ids = {r.w: r.id for r in vocab.collect()}
    counts = Counter(w for _, _, ws in corpus() for w in ws)
    assert set(ids) == {w for w, n in counts.items() if n >= 2}
    sequences = word_ids(docs, vocab, hot_rows=hot_rows)
    got = {r.doc_id: r.ids for r in sequences.collect()}
    want = {i: [ids.get(w, 0) for w in ws] for i, _, ws in corpus()}
    assert got == want

    pairs = skipgrams(sequences, window=2)
    brute = Counter(
        (d, i, j, s[i], s[j]) for d, s in want.items() for i in range(len(s)) for j in range(len(s)) if 0 < abs(i - j) <= 2
    )
    assert Counter(tuple(r) for r in pairs.collect()) == brute
    size = len(ids) + 1
    drawn = negative_pairs(pairs, size).collect()
    assert len(drawn) == sum(brute.values())
    assert all(0 <= r.center < size and 0 <= r.context < size for r in drawn)
    assert sorted(drawn) == sorted(negative_pairs(pairs.repartition(3), size).collect())
    labels = training_pairs(pairs, size).groupBy("label").count().collect()
    assert {r["count"] for r in labels} == {len(drawn)} and len(labels) == 2


@pytest.mark.parametrize("ids", [
    ([0, -7, 123456, None], "long"), (["x" * 36, "x" * 37, "\u00e9" * 19, "", None, "y" * 300], "string")])
def test_draws_of_runs_are_those_of_rows(spark, monkeypatch, ids):
    monkeypatch.setattr(vocabulary_module, "PAIRS", 100)
    keys, kind = ids
    lists = [[(k * 31 + i) % 9 for i in range(n)] for k, n in enumerate([140, 0, 1, 2, 12, 7][: len(keys)])]
    sequences = spark.createDataFrame([*zip(keys, lists), (keys[0], [4, 4, 4]), (keys[1], None)], f"doc_id {kind}, ids array<long>")
    rows, runs = skipgrams(sequences), skipgrams(sequences, runs=True)
    drawn = negative_pairs(runs, 50_021)
    assert dict(drawn.dtypes) == dict(negative_pairs(rows, 50_021).dtypes)
    got, places = Counter(map(tuple, drawn.collect())), rows.select("doc_id", "center_pos", "context_pos").collect()
    want = Counter()
    for doc, center, context in places:
        d = hashlib.md5("|".join(str(x) for x in (42, doc, center, context) if x is not None).encode()).hexdigest()
        want[doc, center, context, int(d[:15], 16) % 50_021, int(d[15:30], 16) % 50_021] += 1
    assert got == want == Counter(map(tuple, negative_pairs(rows, 50_021).collect()))
    trained = Counter(map(tuple, training_pairs(runs, 50_021).collect()))
    assert trained == Counter(map(tuple, training_pairs(rows, 50_021).collect()))


@pytest.mark.parametrize("held", [4_000_000, 10])
def test_totals_of_drawn_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(vocabulary_module, "PAIRS", 64)
    monkeypatch.setattr(vocabulary_module, "HELD_WORDS", held)
    sequences = spark.createDataFrame([(k, [0] * n) for k, n in enumerate([300, 0, 1, 2, 40])], "doc_id long, ids array<long>")
    want = defaultdict(lambda: [0, 0, 0])
    for r in negative_pairs(skipgrams(sequences), 50).collect():
        want[r.center] = [x + y for x, y in zip(want[r.center], (1, r.context, r.context * r.context_pos))]
    totals = negative_pairs(skipgrams(sequences.coalesce(1), runs=True), 50, totals=True)
    assert (totals.count() == len(want)) == (held > 50)
    got = totals.groupBy("center").sum("n_pairs", "sum_context", "weighted_context").collect()
    assert {r[0]: list(r[1:]) for r in got} == want
    with pytest.raises(ValueError):
        negative_pairs(skipgrams(sequences), 50, totals=True)


def test_totals_that_might_not_fit_are_written_before(spark, monkeypatch):
    monkeypatch.setattr(vocabulary_module, "PAIRS", 900)
    runs = [(1, 2_000_000_000, 2_000_000_001, 900, [0], [0])]
    runs = spark.createDataFrame(runs, "doc_id long, center_pos int, context_pos int, n int, center array<long>, context array<long>")
    rows = negative_pairs(runs, 4_000_000).collect()
    totals = negative_pairs(runs.union(runs).coalesce(1), 4_000_000, totals=True).collect()
    assert len(totals) > len({r.center for r in rows})
    assert sum(r.weighted_context for r in totals) == 2 * sum(r.context * r.context_pos for r in rows)


def test_draws_of_runs_write_no_digest_a_pair(spark):
    sequences = spark.createDataFrame([(1, [1, 2, 3])], "doc_id long, ids array<long>")
    plan = negative_pairs(skipgrams(sequences, runs=True), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "inline" not in plan and "MapInArrow" in plan


def test_draws_at_far_places():
    heads = ["42|1|", "42|" + "x" * 36 + "|", "42|" + "x" * 37 + "|", "42|"]
    places = [0, 9, 10, 65_535, 65_536, 9_999_999, 10_000_000, 2**31 - 1]
    cases = [(h, x, y) for h in range(len(heads)) for x in places for y in places]
    of, first, second = (np.array(c) for c in zip(*cases))
    digests = [hashlib.md5(f"{heads[h]}{x}|{y}".encode()).hexdigest() for h, x, y in cases]
    for got, at in zip(Heads(heads).draws(of, first, second), (0, 15)):
        assert got.tolist() == [int(d[at : at + 15], 16) for d in digests]


def test_padded_sequences(spark):
    texts = ["b a, a!", "", None, "a " * 9 + "zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    vocab = sequence_vocabulary(docs, num_words=4)
    assert {r.w: r.id for r in vocab.collect()} == {"a": 2, "b": 3}
    got = {r.doc_id: r.seq for r in padded_sequences(docs, vocab, length=6).collect()}
    assert got == {0: [3, 2, 2, 0, 0, 0], 1: [0] * 6, 2: [0] * 6, 3: [2] * 6}
    tail = padded_sequences(docs, vocab, length=12).where("doc_id = 3").first().seq
    assert tail == [2] * 9 + [1, 0, 0]


def test_lemmas(spark, docs):
    words = spark.createDataFrame(
        [(w,) for w in "cities boxes wolves women buses glass cats unknowns geese churches".split()], "w string"
    )
    lexicon = spark.createDataFrame(
        [(w,) for w in "city box wolf woman bus glass cat goose church boxe glas".split()], "w string"
    )
    exceptions = spark.createDataFrame([("geese", "goose")], "w string, lemma string")
    table = lemma_table(words, lexicon, exceptions)
    assert {r.w: r.lemma for r in table.collect()} == {
        "cities": "city", "boxes": "box", "wolves": "wolf", "women": "woman", "buses": "bus", "glass": "glas",
        "cats": "cat", "geese": "goose", "churches": "church",
    }
    texts = spark.createDataFrame(
        [(1, ["cats", "unknowns", "cats", "cities"]), (2, []), (3, ["geese"])], "doc_id int, tokens array<string>"
    )
    for hot_rows in (100, 1):
        got = {r.doc_id: r.tokens for r in lemmatise(texts, table, hot_rows=hot_rows).collect()}
        assert got == {1: ["cat", "unknowns", "cat", "city"], 2: [], 3: ["goose"]}


@pytest.mark.parametrize("default", [None, "?"])
def test_words_replaced_in_place(spark, default):
    rows = [(1, ["a", "x", None, "a"]), (1, ["b"]), (2, []), (3, None), (None, ["x"])]
    docs = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    for known in ({"a": "A", "b": "B"}, {}):
        table = spark.createDataFrame(list(known.items()), "w string, v string")
        found = lookup.replaced(docs, table, ["doc_id"], "tokens", key="w", value="v", name="new", default=default)
        want = [(i, [known.get(w, w if default is None else default) for w in ws or []]) for i, ws in rows]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_what_a_task_may_hold(spark):
    table = spark.createDataFrame([("ab", 1), ("cd", 2)], "w string, id int")
    assert lookup.fits(table, "w", "id", hot_rows=2, hot_bytes=6)
    assert not lookup.fits(table, "w", "id", hot_rows=1)
    assert not lookup.fits(table, "w", "id", hot_bytes=5)
    assert lookup.fits(table.limit(0), "w", "id", hot_rows=0, hot_bytes=0)


def grams(words):
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_tfidf(rows, min_df=3, max_df=0.95):
    df = Counter(t for _, _, ws in rows for t in set(grams(ws)))
    keep = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items() if min_df <= n <= max_df * len(rows)}
    out = {}
    for i, _, ws in rows:
        raw = {t: n * keep[t] for t, n in Counter(grams(ws)).items() if t in keep}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out |= {(i, t): x / length for t, x in raw.items()}
    return out


@pytest.mark.parametrize("hot_rows", [lookup.HOT_ROWS, 1])
def test_tfidf(docs, monkeypatch, hot_rows):
    monkeypatch.setattr(lookup, "HOT_ROWS", hot_rows)
    got = {(r.doc_id, r.term): r.weight for r in tfidf_transform(docs, tfidf_fit(docs)).collect()}
    assert got == pytest.approx(plain_tfidf(corpus()), abs=1e-12)


def test_weighted_naive_bayes(docs):
    rows, weights = corpus(), plain_tfidf(corpus())
    terms = sorted({t for _, t in weights})
    label = {i: c for i, c, _ in rows}
    total = {c: {t: 0.1 + sum(w for (i, u), w in weights.items() if u == t and label[i] == c) for t in terms}
             for c in ("fake", "real")}
    prior = {c: math.log(sum(x == c for x in label.values()) / len(rows)) for c in total}
    want = {
        i: {c: prior[c] + sum(w * math.log(total[c][t] / sum(total[c].values())) for (j, t), w in weights.items() if j == i)
            for c in total}
        for i in label
    }
    spread = tfidf_transform(docs, tfidf_fit(docs), keep=("label",))
    for r in nb_score_weighted(spread, docs, nb_fit_weighted(spread, docs), keep=("label",)).collect():
        assert (r.s_fake, r.s_real) == pytest.approx((want[r.doc_id]["fake"], want[r.doc_id]["real"]))
        assert r.verdict == ("fake" if r.s_fake >= r.s_real else "real")


def test_logistic_regression(docs):
    """Against Newton steps on the same objective: C * summed log loss + half the squared weights, free intercept."""
    rows, weights = corpus(), plain_tfidf(corpus())
    terms = sorted({t for _, t in weights})
    x = np.array([[weights.get((i, t), 0.0) for t in terms] + [1.0] for i, _, _ in rows])
    y = np.array([1.0 if c == "fake" else 0.0 for _, c, _ in rows])
    c, penalty = 0.25, np.diag([1.0] * len(terms) + [0.0])
    beta = np.zeros(len(terms) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve(c * x.T @ (x * (p * (1 - p))[:, None]) + penalty, c * x.T @ (y - p) - penalty @ beta)
        beta += step
    want = 1 / (1 + np.exp(-x @ beta))
    model = tfidf_fit(docs)
    spread = tfidf_transform(docs, model, keep=("label",))
    fitted = logistic_fit(spread, docs, c=c, tol=3e-7, max_steps=150, chained=15)
    assert fitted.steps < 150 and fitted.gradient <= 3e-7
    coefficients = {r.term: r.w for r in fitted.coefficients.collect()}
    assert [coefficients[t] for t in [*terms, INTERCEPT]] == pytest.approx(list(beta), abs=1e-5)
    got = {r.doc_id: r.p_fake for r in logistic_score(spread, docs, fitted).collect()}
    assert [got[i] for i, _, _ in rows] == pytest.approx(list(want), abs=1e-5)


def test_regression_of_no_documents(docs):
    none = docs.limit(0)
    spread = tfidf_transform(docs, tfidf_fit(docs), keep=("label",))
    fitted = logistic_fit(spread.limit(0), none)
    assert fitted.size == 0 and {r.p_fake for r in logistic_score(spread, docs, fitted).collect()} == {0.5}


@pytest.mark.parametrize("hot_rows", [100, 2])
def test_doc_vectors(spark, docs, hot_rows):
    vocab = vocabulary(docs, min_count=2)
    ids = {r.w: r.id for r in vocab.collect()}
    rng = random.Random(2)
    given = {w: [rng.uniform(-1, 1) for _ in range(4)] for w in ids}
    vectors = spark.createDataFrame([(w, ids[w], v) for w, v in given.items()], "w string, id long, vec array<double>")
    means = doc_vectors(docs, vectors, dim=4, keep=("label",), hot_rows=hot_rows)
    got = {r.doc_id: r for r in means.collect()}
    assert len(got) == len(corpus())
    for i, _, ws in corpus():
        known = [given[w] for w in ws if w in given]
        assert got[i].n_known == len(known)
        assert got[i].vec == pytest.approx(list(np.mean(known, axis=0)) if known else [0.0] * 4)

    protos = {r.label: r.vec for r in prototypes(means, dim=4).collect()}
    for c in ("fake", "real"):
        rows = [got[i].vec for i, x, _ in corpus() if x == c and any(got[i].vec)]
        assert protos[c] == pytest.approx(list(np.mean(rows, axis=0)))
    for r in nearest(means, prototypes(means, dim=4), dim=4).collect():
        assert r.verdict == ("fake" if r.sim_fake > r.sim_real else "real")
        assert -1.0000001 <= r.sim_fake <= 1.0000001


def test_missing_prototype_is_zero(spark):
    vectors = spark.createDataFrame([("fake", [0.0, 0.0]), ("real", [1.0, 0.0])], "label string, vec array<double>")
    got = {r.label: (r.sim_fake, r.sim_real, r.verdict) for r in nearest(vectors, prototypes(vectors, dim=2), dim=2).collect()}
    assert got == {"fake": (0.0, 0.0, "real"), "real": (0.0, 1.0, "real")}


@pytest.mark.parametrize("hot_numbers", [8_000_000, 1])
def test_trained_vectors_equal_plain_steps(docs, monkeypatch, hot_numbers):
    monkeypatch.setattr(vectors_module, "HOT_NUMBERS", hot_numbers)
    dim, vocab = 4, vocabulary(docs, min_count=2)
    got = {r.id: r.vec for r in word_vectors(docs, vocab, dim=dim, epochs=2, batches=2, rate=0.4).collect()}
    ids = {r.w: r.id for r in vocab.collect()}
    weights = defaultdict(lambda: [0, 0])
    for i, _, words in corpus():
        line = [ids.get(w, 0) for w in words]
        for x in range(len(line)):
            for y in range(max(0, x - 5), min(len(line), x + 6)):
                if x != y:
                    d = hashlib.md5(f"42|{i}|{x}|{y}".encode()).hexdigest()
                    drawn = [int(d[k : k + 15], 16) % (len(ids) + 1) for k in (0, 15)]
                    for k, (a, b) in enumerate(((line[x], line[y]), drawn)):
                        weights[a, b][k] += 1
                        weights[b, a][k] += 1
    vec, power = np.zeros((len(ids) + 1, dim)), np.zeros(len(ids) + 1)
    for i in range(len(vec)):
        for k in range(dim):
            d = hashlib.md5(f"42|{i}|{k // 2}".encode()).hexdigest()
            vec[i, k] = (int(d[15 * (k % 2) : 15 * (k % 2) + 15], 16) % (1 << 20) / (1 << 20) - 0.5) * 0.1
    for step in range(4):
        g = np.zeros_like(vec)
        for (a, b), (pos, neg) in weights.items():
            if (a + b) % 2 == step % 2:
                p = 1 / (1 + np.exp(-vec[a] @ vec[b]))
                g[a] += (pos * (1 - p) - neg * p) * vec[b]
        power += (g * g).sum(axis=1)
        vec += g * np.where(power > 0, 0.4 / np.sqrt(np.maximum(power, 1e-300)), 0)[:, None]
    assert set(got) == set(ids.values())
    for i, v in got.items():
        assert v == pytest.approx(list(vec[i]), abs=1e-9)


def test_words_of_one_topic_get_near_vectors(spark):
    rng = random.Random(12)
    rows = [(i, [f"{'xy'[i % 2]}{rng.randrange(8)}" for _ in range(30)]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    found = {r.w: np.array(r.vec) for r in word_vectors(docs, vocabulary(docs), dim=12).collect()}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    near = [cosine(found[a], found[b]) for a in found for b in found if a < b and a[0] == b[0]]
    far = [cosine(found[a], found[b]) for a in found for b in found if a < b and a[0] != b[0]]
    assert min(near) > max(far)


@pytest.mark.parametrize("rows, size", [(0, 10**6), (1, 10**6), (7, 10**6), (29, 10**6), (10**6, 0), (10**6, 400), (10**6, 10**6)])
def test_most_frequent_words_without_sorting(spark, rows, size):
    counts = [(f"w{i}", n) for i, n in enumerate([1] * 12 + [2] * 9 + [3, 5, 5, 8, 90, 91, 5_000, 10**12])] + [("longer" * 9, 4)]
    table = spark.createDataFrame(counts, "w string, n long")
    head, tail = lookup.by_count(table, "w", "n", rows, size)
    width = lambda w: len(w) + 16
    kept = {r.w: r.n for r in head.collect()}
    left = {} if tail is None else {r.w: r.n for r in tail.collect()}
    assert {**kept, **left} == dict(counts) and not set(kept) & set(left)
    if tail is not None:
        assert len(kept) <= rows and sum(map(width, kept)) <= size
        assert not kept or min(kept.values()) >= max(left.values()) * 2 ** (-1 / lookup.STEPS)
        for df in (head, tail):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "TakeOrdered" not in plan and "Exchange" not in plan
    else:
        assert len(counts) <= rows and sum(width(w) for w, _ in counts) <= size


def test_lemmas_round_by_round(spark):
    forms = "glasss bosses xsess lessss sss classes men foxesses mice feet oddlys".split()
    words = spark.createDataFrame([(w,) for w in forms], "w string")
    lexicon = spark.createDataFrame([(w,) for w in "gla bos xs le cla man foxe mouse odd ee".split()], "w string")
    irregular = spark.createDataFrame([("mice", "mouse"), ("feet", "foot"), ("oddlys", "odd")], "w string, lemma string")
    got = {r.w: r.lemma for r in lemma_table(words, lexicon, irregular).collect()}
    assert got == {"glasss": "gla", "bosses": "bos", "xsess": "xs", "lessss": "le", "classes": "cla", "men": "man",
                   "foxesses": "foxe", "mice": "mouse", "oddlys": "odd"}


def test_large_and_small_word_tables_give_the_same_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trustloom.operators import lemmas, vocabulary as words

    rows = [(1, "b a"), (1, "a c"), (None, "c b"), (None, "z"), (2, None), (3, "a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.split("text", " "))
    vocab = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4)], "w string, id int")
    forms = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "x")], "w string, lemma string")
    same = lambda df: sorted(map(str, df.collect()))
    small = [same(words.word_ids(docs, vocab)), same(lemmas.lemmatise(docs, forms)), same(words.padded_sequences(docs, vocab, length=3))]
    monkeypatch.setattr(lookup, "fits", lambda *a, **k: False)
    large = [same(words.word_ids(docs, vocab, hot_rows=1)), same(lemmas.lemmatise(docs, forms, hot_rows=1)),
             same(words.padded_sequences(docs, vocab, length=3))]
    assert small == large and [len(x) for x in small] == [6, 6, 6]


@pytest.mark.parametrize("hot_terms", [1000, 12])
def test_regression_moves_no_entries_of_held_terms(docs, tmp_path, hot_terms, monkeypatch):
    """What steps shuffle are sums by term, however many entries there are; rare terms travel and count as well."""
    from trustloom.operators import linear

    spread = tfidf_transform(docs, tfidf_fit(docs), keep=("label",)).persist()
    seen = []
    monkeypatch.setattr(linear, "_gradients", lambda d, *a, f=linear._gradients: seen.append(d) or f(d, *a))
    fitted = logistic_fit(spread, docs, max_steps=5, tol=0.0, chained=2, hot_terms=hot_terms)
    every = spread.unionByName(docs.selectExpr("doc_id", "label", "'' term", "1d weight")).collect()
    terms, ids = sorted({r.term for r in every}), sorted({r.doc_id for r in every})
    x, y = np.zeros((len(ids), len(terms))), np.zeros(len(ids))
    for r in every:
        x[ids.index(r.doc_id), terms.index(r.term)], y[ids.index(r.doc_id)] = r.weight, r.label == "fake"
    w, u, bend = np.zeros(len(terms)), np.zeros(len(terms)), (x * x).sum(axis=1).max() / 4 + 1 / len(ids)
    root = math.sqrt(bend * len(ids))
    for _, limit in zip(range(5), linear.momentum_limits()):
        g = x.T @ (1 / (1 + np.exp(-x @ u)) - y) / len(ids) + u / len(ids) * (np.array(terms) != "")
        w, old = u - g / bend, w
        u = w + min(limit, (root - 1) / (root + 1)) * (w - old)
    assert {r.term: r.w for r in fitted.coefficients.collect()} == pytest.approx(dict(zip(terms, w)), abs=1e-9)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
    assert len(plans) == 5 and all(("Exchange" in p or "Join" in p) == (hot_terms < len(terms)) for p in plans)


@pytest.mark.parametrize("part, few", [(1 << 18, False), (7, True)])
def test_regression_sums_leave_tasks_in_arrays(docs, monkeypatch, part, few):
    """A row a task and part of the terms, not one a term; a part of which a task has few terms says which."""
    from trustloom.operators import linear

    monkeypatch.setattr(linear, "PART", part)
    spread = tfidf_transform(docs, tfidf_fit(docs), keep=("label",)).persist()
    seen = []
    monkeypatch.setattr(linear, "_gradients", lambda *a, f=linear._gradients: seen.append((f(*a), a[1], a[0])) or seen[-1][0])
    fitted = logistic_fit(spread, docs, max_steps=1, tol=0.0)
    (sums, _), u, read = seen[0]
    assert len(u) == fitted.size and {*read.columns} == {"row", "y", "at", "x", "z"}
    sums, _ = linear._gradients(read.limit(1) if few else read, u, 1, False)
    got = sums.collect()
    assert len(got) <= sums.rdd.getNumPartitions() * -(-len(u) // part) < len(u)
    assert not few or any(r["at"] is not None and len(r["at"]) // 4 == len(r["s"]) // 8 for r in got)
    w = {r.term: r.w for r in fitted.coefficients.collect()}
    y = [r.label == "fake" for r in docs.collect()]
    assert len(w) == len(u) and np.sign(w[INTERCEPT]) == np.sign(np.mean(y) - 0.5)


def test_trained_vectors_by_ranges_of_words(docs, monkeypatch):
    """Pairs are read row by row and meet their vectors without a join, whether these are held in one range or in many."""
    vocab, seen = vocabulary(docs, min_count=2), []
    monkeypatch.setattr(
        vectors_module, "_pair_gradients", lambda *a, f=vectors_module._pair_gradients: seen.append(f(*a)) or seen[-1])
    one = {r.id: r.vec for r in word_vectors(docs, vocab, dim=3, epochs=1, batches=2).collect()}
    assert len(seen) == 2
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert not any("Exchange" in p or "Join" in p for p in plans)
    monkeypatch.setattr(vectors_module, "HOT_NUMBERS", 1)
    monkeypatch.setattr(vectors_module, "LEAST_HELD", 16)
    many = {r.id: r.vec for r in word_vectors(docs, vocab, dim=3, epochs=1, batches=2).collect()}
    assert len(seen) == 2 + 2 * 2 ** 2 and set(many) == set(one)
    assert all(many[i] == pytest.approx(v, abs=1e-12) for i, v in one.items())


@pytest.mark.parametrize("entries, row_entries, cells", [(8_000_000, 200_000, 3), (100, 4, 1), (100, 4, 12)])
def test_training_pairs_are_counted_where_they_are_made(spark, monkeypatch, entries, row_entries, cells):
    """A row a cell and count leaves the task, not a row a pair; counts of a cell meet in one place, in both roles."""
    from trustloom.operators import pair_cells

    monkeypatch.setattr(vocabulary_module, "PAIRS", 30)
    lists = [[(k * 31 + i * i) % 12 for i in range(n)] for k, n in enumerate([40, 0, 1, 2, 300])]
    sequences = spark.createDataFrame([*enumerate(lists), (7, [5] * 300), (8, None)], "doc_id long, ids array<long>")
    want = defaultdict(lambda: [0, 0])
    for r in training_pairs(skipgrams(sequences), 12).collect():
        for pair in ((r.center, r.context), (r.context, r.center)):
            want[pair][1 - r.label] += 1
    layout = pair_cells.Cells(12, cells, 2, 5, entries, row_entries)
    counted = training_pairs(skipgrams(sequences.coalesce(1), runs=True), 12, cells=layout)
    rows = counted.count()
    assert rows == cells if entries > 100 else rows > cells
    assert "Generate" not in str(counted._jdf.queryExecution().executedPlan()).split("MapInArrow")[0]
    got = {}
    for r in vectors_module.pair_weights(counted, layout).collect():
        words, sizes, partners, times = pair_cells.unpacked([bytes(r[c]) for c in pair_cells.FIELDS])
        assert len(words) == 1 or len(partners) <= row_entries
        for a, b, n in zip(np.repeat(words, sizes).tolist(), (partners + r.at_b * 5).tolist(), times.T.tolist()):
            assert (a // 5, (a + b) % 2) == (r.at_a, r.batch) and (a, b) not in got
            got[a, b] = n
    assert got == dict(want)


@pytest.mark.parametrize("dim, at_once", [(5, 16_384), (4, 7)])
def test_vectors_start_with_numbers_taken_many_at_a_time(spark, monkeypatch, dim, at_once):
    monkeypatch.setattr(vectors_module, "DIGESTS_AT_ONCE", at_once)
    ids = [0, 7, 123, 20_000_000_000]
    start = vectors_module._start(spark.createDataFrame([(i,) for i in ids], "id long"), dim, 42)
    assert "md5" not in start._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i in ids:
        digests = [hashlib.md5(f"42|{i}|{k // 2}".encode()).hexdigest()[15 * (k % 2) :][:15] for k in range(dim)]
        want[i] = [(int(d, 16) % (1 << 20) / (1 << 20) - 0.5) * 0.1 for d in digests]
    assert {r.id: r.vec for r in start.collect()} == want and {r.power for r in start.collect()} == {0.0}


def test_packed_counts_of_any_size():
    from trustloom.operators import pair_cells

    for most in (1, 255, 256, 70_000, 1 << 33):
        row = pair_cells._row(*(np.array(x) for x in ([3, 9], [2, 1], [7, 8, (1 << 32) - 1], [0, 1, most], [1, 0, 2])))
        words, sizes, partners, times = (x.tolist() for x in pair_cells.unpacked(row))
        assert (words, sizes, partners, times) == ([3, 9], [2, 1], [7, 8, (1 << 32) - 1], [[0, 1, most], [1, 0, 2]])


def test_a_task_works_on_a_few_list_entries_at_a_time(docs, monkeypatch):
    """However long the lists of a batch are."""
    import pyarrow as pa

    rows = [["a"] * 3, None, [], ["b"] * 9, ["c"], ["d", None]]
    batch = pa.record_batch([pa.array(range(6)), pa.array(rows, pa.list_(pa.string()))], names=["i", "l"])
    parts = [p.column(1).to_pylist() for p in lookup.pieces(batch, 1, 4)]
    assert sum(parts, []) == rows and [sum(len(x or []) for x in p) for p in parts] == [3, 9, 3]
    vocab = vocabulary(docs, min_count=2)
    whole = sorted(map(str, word_ids(docs, vocab).collect()))
    monkeypatch.setattr(lookup, "ENTRIES", 7)
    assert sorted(map(str, word_ids(docs, vocab).collect())) == whole


def test_a_large_table_is_hashed_and_not_sorted(spark, monkeypatch):
    many = spark.range(400).selectExpr("id % 50 k", "id x")
    table = spark.range(300).selectExpr("id k", "id * 2 y")
    plans = []
    for most in (500_000, 1):
        monkeypatch.setattr(lookup, "HASHED_ROWS", most)
        met = many.join(lookup.bounded(table, 300, 100), "k")
        assert sorted(map(tuple, met.select("x", "y").collect())) == [(x, x % 50 * 2) for x in range(400)]
        plans.append(met._jdf.queryExecution().sparkPlan().toString())
    assert "ShuffledHashJoin" in plans[0] and "ShuffledHashJoin" not in plans[1]


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_tfidf_counts_within_the_row(spark, monkeypatch, hot_rows):
    """Rows that share an id are one document, groups of words do not cross rows, and counting needs no shuffle."""
    from trustloom.operators import tfidf

    monkeypatch.setattr(lookup, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(tfidf, "LENGTHS", hot_rows)
    rows = [(1, ["a", "b", "a", "b"]), (1, ["b", "b"]), (None, ["a", "b", "c"]), (2, None), (3, []), (4, ["c", "a", "b"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    grams = tfidf._gram_counts(docs, ["doc_id"], "tokens", 3)
    want = Counter((k, i, " ".join(ws[x : x + n])) for k, (i, ws) in enumerate(rows) for n in (1, 2, 3) for x in range(len(ws or []) - n + 1))
    assert sorted(map(str, map(tuple, grams.collect()))) == sorted(str((i, t, n)) for (_, i, t), n in want.items())
    assert "Exchange" not in grams._jdf.queryExecution().executedPlan().toString()
    model = tfidf_fit(docs, min_df=2, max_df=1.0)
    got = {(r.doc_id, r.term): r.weight for r in tfidf_transform(docs, model).collect()}
    df = Counter(t for _, ws in rows for t in {*(ws or []), *map(" ".join, zip(ws or [], (ws or [])[1:]))})
    raw = Counter()
    for (_, i, t), n in want.items():
        if t.count(" ") < 2 and df[t] >= 2:
            raw[i, t] += n * (math.log(7 / (1 + df[t])) + 1)
    length = {i: math.sqrt(sum(x * x for (j, _), x in raw.items() if j == i)) for i, _ in rows}
    assert got == pytest.approx({(i, t): x / length[i] for (i, t), x in raw.items()})


def test_rare_words_travel_without_the_frequent_ones(docs, monkeypatch):
    """Beside the held vectors only words that these lack are shuffled, and no row per occurrence of the others."""
    vocab = vocabulary(docs, min_count=2)
    vectors = vocab.selectExpr("w", "id", "array(double(id), 1d) vec")
    seen = []
    monkeypatch.setattr(vectors_module, "_summed", lambda *a, f=vectors_module._summed, **k: seen.append(f(*a, **k)) or seen[-1])
    means = {r.doc_id: r for r in doc_vectors(docs, vectors, dim=2, hot_rows=5).collect()}
    left = {r.doc_id: r.missed for r in seen[0].collect()}
    held = {r.w for r in vocab.collect() if r.id <= 5}
    assert left == {i: [w for w in ws if w not in held] for i, _, ws in corpus()}
    known = {r.w for r in vocab.collect()}
    assert all(means[i].n_known == sum(w in known for w in ws) for i, _, ws in corpus())
