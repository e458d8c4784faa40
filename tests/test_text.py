import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustloom.functions.scalar import (
    as_label,
    clamp,
    cosine,
    flag_or_marker,
    is_fake,
    round_half_even,
    threshold_verdict,
    two_class_probability,
)
from trustloom.functions.text import CLEANERS, ngrams, sequence_words, tokeniser
from trustloom.operators.naive_bayes import term_counts


def words(spark, cleaner, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(tokeniser(cleaner)(F.col("t")).alias("w")).first().w


@pytest.mark.parametrize("cleaner,text,want", [
    ("a", "Alpha\nBeta", ["alphabeta"]),
    ("b", "Alpha\nBeta", ["alpha", "beta"]),
    ("b", "Alpha Beta gamma", ["alpha", "beta", "gamma"]),
    ("a", "Alpha Beta", ["alphabeta"]),
    ("a", "don't", ["dont"]),
    ("b", "don't", ["dont"]),
    ("a", "", []),
    ("b", None, []),
    ("c", None, []),
    ("a", "The cat, 2 dogs & an OX!", ["cat", "dogs"]),
    ("b", "all about their budget", ["budget"]),
    ("c", "We cannot wait, gonna go", ["wait", "gon"]),
    ("c", "cannots gotta", ["cannots", "got"]),
])
def test_cleaners(spark, cleaner, text, want):
    assert words(spark, cleaner, text) == want


def test_stop_lists_differ(spark):
    assert {c: words(spark, c, "after themselves with policy") for c in CLEANERS} == {
        "a": ["after", "themselves", "policy"], "b": ["themselves", "policy"], "c": ["policy"],
    }


def test_own_tokeniser(spark):
    df = spark.createDataFrame([("a-b",)], "t string")
    assert df.select(tokeniser(lambda c: F.split(c, "-"))(F.col("t"))).first()[0] == ["a", "b"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(ngrams(F.col("w"), 2)).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]
    three = df.select(ngrams(F.col("w"), 3)).first()[0]
    assert three == ["a", "b", "c", "a b", "b c", "a b c"]


def test_sequence_words(spark):
    df = spark.createDataFrame([("Hello, World! it's\tA-B  c",)], "t string")
    assert df.select(sequence_words(F.col("t"))).first()[0] == ["hello", "world", "it's", "a", "b", "c"]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_formulas(spark):
    lit = F.lit
    assert value(spark, round_half_even(lit(2.5))) == 2
    assert value(spark, round_half_even(lit(3.5))) == 4
    assert value(spark, clamp(lit(120.0))) == 100.0
    assert value(spark, threshold_verdict(lit(0.5))) == "real"
    assert value(spark, as_label(lit(1))) == "real"
    assert [value(spark, flag_or_marker(lit(x))) for x in (0, 1, 2)] == [0, 1, -1]
    assert value(spark, flag_or_marker(lit(None).cast("int"))) == -1
    assert value(spark, two_class_probability(lit(-5000.0), lit(-5000.0))) == 0.5
    assert value(spark, two_class_probability(lit(-5000.0), lit(-9000.0))) == 1.0
    assert value(spark, two_class_probability(lit(-9000.0), lit(-5000.0))) == 0.0
    minus = lit(float("-inf"))
    assert value(spark, two_class_probability(minus, minus)) == 0.5
    a, zero = F.array(lit(3.0), lit(4.0)), F.array(lit(0.0), lit(0.0))
    assert value(spark, cosine(a, a)) == pytest.approx(1.0)
    assert value(spark, cosine(a, zero)) == 0.0
    assert value(spark, cosine(a, F.array(lit(1.0)))) == 0.0


def test_other_labels_are_refused(spark):
    with pytest.raises(Exception, match="fake or real"):
        value(spark, is_fake(F.lit("satire")))


def test_a_tokeniser_of_the_caller_runs_once_per_text(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<string>")
    def halves(texts: pa.Array) -> pa.Array:
        seen.add(len(texts))
        return pa.array([[t[: len(t) // 2], t[len(t) // 2 :]] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    docs = spark.createDataFrame([(i, "fake" if i % 2 else "real", f"abcd{i}") for i in range(20)] + [(99, "real", None)],
                                 "doc_id int, label string, text string")
    counts = term_counts(docs.select("label", tokeniser(halves)(F.col("text")).alias("tokens")))
    got = {r.w: (r.n_fake, r.n_real) for r in counts.collect()}
    assert seen.value == 21 and got["ab"] == (5, 5) and got["cd3"] == (1, 0)
