"""Text cleaning as column expressions, so that tokenising stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.constants import (
    CONTRACTIONS,
    SEQUENCE_SEPARATORS,
    STOP_A,
    STOP_B,
    STOP_C,
)

Tokeniser = Callable[[Column], Column]

# Whitespace by the Unicode definition.
WHITESPACE = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


def keep_words(words: Column, stop: Sequence[str], min_len: int = 3) -> Column:
    """Drop stop words and words shorter than ``min_len``; the stop list becomes a hash-set test."""
    return F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(*stop))


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _blanked(text: Column, characters: str) -> Column:
    """Each of ``characters`` as a blank. A regular expression on a class this wide costs several times as much."""
    return F.translate(text, characters, " " * len(characters))


def _letters(text: Column) -> Column:
    """Everything but a-z and the blank removed, so letters on both sides of what is removed move together."""
    return F.regexp_replace(text, "[^a-z ]+", "")


def clean_a(text: Column, stop: Sequence[str] = STOP_A) -> Column:
    """Only the blank separates words: those on both sides of a line break merge."""
    return keep_words(F.split(_letters(_lowered(text)), " +"), stop)


def clean_b(text: Column, stop: Sequence[str] = STOP_B) -> Column:
    """Any whitespace separates words."""
    return keep_words(F.split(_letters(_blanked(_lowered(text), WHITESPACE)), " +"), stop)


def clean_c(text: Column, stop: Sequence[str] = STOP_C) -> Column:
    """As ``clean_b`` with contractions cut in two. Lemmas, if wanted, come from ``operators.lemmas`` afterwards."""
    heads = "|".join(rf"{head}(?={tail}\b)" for head, tail in CONTRACTIONS)
    parted = F.regexp_replace(_letters(_blanked(_lowered(text), WHITESPACE)), rf"\b({heads})", "$1 ")
    return keep_words(F.split(parted, " +"), stop)


CLEANERS: dict[str, Tokeniser] = {"a": clean_a, "b": clean_b, "c": clean_c}


def tokeniser(cleaner: str | Tokeniser) -> Tokeniser:
    """A cleaner by name, or any ``Column -> array<string>`` callable (a pandas UDF fits too)."""
    return CLEANERS[cleaner] if isinstance(cleaner, str) else cleaner


def sequence_words(text: Column) -> Column:
    """Lower-cased words for integer sequences: punctuation becomes a blank, nothing else is dropped."""
    return F.filter(F.split(_blanked(_lowered(text), SEQUENCE_SEPARATORS), " +"), lambda w: w != "")


def occurrences(docs: DataFrame, words: Column | str, *keep: str | Column, name: str = "w") -> DataFrame:
    """One row per word with ``keep``. The outer form is meant: for the inner one the optimizer adds a filter on the size
    of the array below it, which tokenises every text a second time."""
    return docs.select(*keep, F.explode_outer(words).alias(name)).where(F.col(name).isNotNull())


def ngrams(words: Column, up_to: int = 2) -> Column:
    """The words followed by the adjacent pairs (``up_to=2``), triples and so on, joined by a blank."""
    grams = [words]
    for n in range(2, up_to + 1):
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        joined = F.slice(words, 1, count)
        for shift in range(2, n + 1):
            joined = F.zip_with(joined, F.slice(words, shift, count), lambda x, y: F.concat_ws(" ", x, y))
        grams.append(joined)
    return F.concat(*grams) if len(grams) > 1 else words
