"""Small column formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_label(quality: Column) -> Column:
    """1 is real, anything else fake."""
    return F.when(quality == 1, F.lit("real")).otherwise(F.lit("fake"))


def is_fake(label: Column) -> Column:
    """fake 1, real 0; any other label is an error, since the classes are closed."""
    return (
        F.when(label == "fake", F.lit(1))
        .when(label == "real", F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("label must be fake or real: "), F.coalesce(label, F.lit("null")))))
        .cast("int")
    )


def threshold_verdict(score: Column, cut: float = 0.5) -> Column:
    return F.when(score > cut, F.lit("fake")).otherwise(F.lit("real"))


def argmax_verdict(fake: Column, real: Column) -> Column:
    """A tie, or a missing score on both sides, is real."""
    return F.when(fake > real, F.lit("fake")).otherwise(F.lit("real"))


def flag_or_marker(score: Column) -> Column:
    """0 and 1 pass, everything else (null too) is the error marker -1."""
    return F.when(score.isin(0, 1), score).otherwise(F.lit(-1)).cast("int")


def two_class_probability(fake: Column, real: Column) -> Column:
    """Softmax of two log scores for the first one. Written on the difference: the exponentials of long texts underflow
    one by one, their ratio does not. Equal infinite scores give 0.5."""
    return F.when(fake == real, F.lit(0.5)).otherwise(1.0 / (1.0 + F.exp(real - fake)))


def blend(content_fake: Column, source_trust: Column, w_content: float = 0.7, w_source: float = 0.3) -> Column:
    """Weighted evidence for fake; the weights are used as given, not normalised."""
    return F.lit(w_content) * content_fake + F.lit(w_source) * (1.0 - source_trust)


def damped(direct: Column, network: Column, damping: float = 0.85) -> Column:
    return F.lit(1.0 - damping) * direct + F.lit(damping) * network


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def seeded_hash(seed: int, *ids: Column) -> Column:
    """A hex digest that orders rows at random but the same way on every run and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def hash_draw(digest: Column, word: int, bound: Column) -> Column:
    """A number in [0, bound) from the ``word``-th 15-digit group (60 bits) of a hex digest, of which there are two."""
    return F.conv(F.substring(digest, 15 * word + 1, 15), 16, 10).cast("bigint") % bound


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch. A timestamp without zone is read as it stands, whatever the session zone, so
    clock changes of that zone never stretch a gap."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.unix_micros(ts)
    seconds = F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")
