"""Byte-pair encoding with a public vocabulary, by an index from each pair to all its positions."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.llm.rows import column, packed, table, unpacked
from trustloom.llm.words import small_batches

CACHE_WORDS = 350_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file (BPE with word ends over bytes)."""

    def __init__(self, definition: str):
        self.definition = definition
        parts = json.loads(definition)
        model = parts["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in self.ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: By rank: the two ids that merge and the id they become.
        self.merge = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges]
        self.size = max(self.ids.values()) + 1
        #: The rank of a pair, both ids in one number.
        self.rank_of = {a * self.size + b: rank for rank, (a, b, _) in reversed(list(enumerate(self.merge)))}
        self.letters = byte_letters()
        self.inner, self.last = ([self.ids[c + e] for c in self.letters] for e in ("", self.end))
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        splits = [p["pattern"]["Regex"] for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word = regex.compile(splits[0])
        self.assigned: set[str] = set()
        self.library = None
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None

    def words(self, text: str) -> list[str]:
        """The words of a text: composed characters, small letters, no white space. A special token's own string stays
        whole (no word can equal it, as it mixes letters and signs)."""
        if self.special is not None and "<|" in text:
            found, at = [], 0
            for m in self.special.finditer(text):
                found += self._plain(text[at : m.start()])
                found.append(m.group())
                at = m.end()
            return found + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            new = set(text) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in new):
                return self._newer(text)
            self.assigned |= new
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: the one letter that Python lowers by what stands around it is lowered first.
        return self.word.findall(text.replace("Σ", "σ").lower())

    def _newer(self, text: str) -> list[str]:
        """For letters that Python's tables do not have yet, the tokenizer library's own tables decide what is a word."""
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_str(self.definition)
        byte = {c: b for b, c in enumerate(self.letters)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(byte[c] for c in word).decode() for word, _ in found]


def merge_words(words: Iterable[str], vocab: Vocabulary) -> list[list[int]]:
    """The token ids of each word.

    All words lie in one array of symbols, linked to their neighbours within the word. An index maps each pair that has
    a merge (by its rank) to all the positions where it stands, in whatever word. The active pair of lowest rank is
    merged at all its positions, left to right; each merge adds the two pairs it makes to the lists of those pairs.
    Lists may hold positions that are gone by then: a position counts only if the pair still stands there. If a merge
    makes a pair of lower rank than its own, that one goes first and the rest of the list waits.
    """
    symbols: list[int] = []
    ends: list[int] = []
    inner, last = vocab.inner, vocab.last
    for word in words:
        data = word.encode()
        symbols += [inner[b] for b in data[:-1]]
        symbols.append(last[data[-1]])
        ends.append(len(symbols))
    if not symbols:
        return []
    starts = [0, *ends[:-1]]
    left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    for i in starts:
        left[i] = -1
    for i in ends:
        right[i - 1] = -1

    rank_of, size, where = vocab.rank_of, vocab.size, {}
    flat = np.array(symbols, dtype=np.int64)
    pairs = flat[:-1] * size + flat[1:]
    pairs[np.array(ends[:-1], dtype=np.int64) - 1] = -1  # no pair reaches over a word's end
    distinct, inverse = np.unique(pairs, return_inverse=True)
    ranks = np.array([rank_of.get(x, -1) for x in distinct.tolist()], dtype=np.int64)[inverse]
    order = np.argsort(ranks, kind="stable")
    order = order[np.searchsorted(ranks[order], 0) :]
    for places in np.split(order, np.flatnonzero(np.diff(ranks[order])) + 1) if len(order) else []:
        where[int(ranks[places[0]])] = places.tolist()
    active = sorted(where)  # a sorted list is a heap
    push, pop = heapq.heappush, heapq.heappop
    while active:
        rank = pop(active)
        places = where.pop(rank)
        a, b, merged = vocab.merge[rank]
        places.sort()
        lowest = rank
        for k, i in enumerate(places):
            j = right[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = merged
            symbols[j] = -1
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                made = rank_of.get(merged * size + symbols[after])
                if made is not None:
                    if made in where:
                        where[made].append(i)
                    else:
                        where[made] = [i]
                        push(active, made)
                        lowest = min(lowest, made)
            before = left[i]
            if before >= 0:
                made = rank_of.get(symbols[before] * size + merged)
                if made is not None:
                    if made in where:
                        where[made].append(before)
                    else:
                        where[made] = [before]
                        push(active, made)
                        lowest = min(lowest, made)
            if lowest < rank:
                if k + 1 < len(places):
                    if rank in where:
                        where[rank] += places[k + 1 :]
                    else:
                        where[rank] = places[k + 1 :]
                        push(active, rank)
                break
    out = []
    for i in starts:
        ids = []
        while i >= 0:
            ids.append(symbols[i])
            i = right[i]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts a batch at a time and remembers up to ``CACHE_WORDS`` words: as the bytes of their ids, or for
    ``digests`` as number of tokens, decimal ids joined by a blank and token strings joined by a blank."""

    def __init__(self, vocab: Vocabulary, digests: bool = False):
        self.vocab, self.digests = vocab, digests
        self.known: dict[str, bytes | tuple[int, str, str]] = {}

    def _entry(self, ids: list[int]) -> bytes | tuple[int, str, str]:
        if self.digests:
            return len(ids), " ".join(map(str, ids)), " ".join(map(self.vocab.tokens.__getitem__, ids))
        return np.array(ids, dtype=np.int32).tobytes()

    def entries(self, texts: Iterable[str | None]) -> Iterator[list]:
        """The entry of each word of each text."""
        cut = [self.vocab.words(t) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = {w for words in cut for w in words}
        special = self.vocab.added
        plain = [w for w in new if w not in special]
        for word, ids in zip(plain, merge_words(plain, self.vocab)):
            self.known[word] = self._entry(ids)
        for word in new.intersection(special):
            self.known[word] = self._entry([special[word]])
        known = self.known
        return ([known[w] for w in words] for words in cut)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(words), dtype=np.int32) for words in self.entries(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """The token strings joined by a blank; ids without token are passed over."""
        return " ".join(t for i in ids if (t := self.vocab.tokens.get(i)) is not None)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(definition: str, digests: bool = False) -> Encoder:
    """One encoder per Python worker, so that words stay known from batch to batch and task to task."""
    key = (hashlib.sha1(definition.encode()).hexdigest(), digests)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(definition), digests)
    return _ENCODERS[key]


def _shared_definition(docs: DataFrame, path: str):
    """The vocabulary file, a few MB whatever the input, read where the driver runs and sent once to each executor."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _with_columns(docs: DataFrame, source: str, run, added: list[tuple[str, str]]) -> DataFrame:
    """``docs`` with columns that ``run(values)`` makes from column ``source``; they replace columns of those names."""
    kept = [c for c in docs.columns if c not in dict(added)]
    rows = packed(docs).select(column(source, "row").alias("text"), F.struct(*unpacked(docs, kept)).alias("row"))
    out = T.StructType([rows.schema["row"], *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in added)).fields])

    is_text = rows.schema["text"].dataType == T.StringType()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small pieces, so that no more than the tokens of one are held at a time.
        pieces = small_batches(parts, "text") if is_text else parts
        for part in pieces:
            yield pa.RecordBatch.from_arrays([part.column("row"), *run(part)], names=["row", *(n for n, _ in added)])

    return rows.mapInArrow(batches, out).select(
        *(column(c, "row").alias(c) for c in kept), *(column(n) for n, _ in added))


def bpe_encode(docs: DataFrame, *, text: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens``; with ``digests`` instead ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by one space) and ``decoded_sha256`` (of ``bpe_decode`` of the ids). Added columns replace
    columns of those names; rows are neither added nor lost.

    The whole text is encoded by the tokenizer file at ``path``, without adding special tokens; where the text spells
    one out, it is that token. Null and empty texts, and texts of white space, have no tokens. Documents never leave
    their task. Each distinct word of a batch is merged once, together with all other words of it, and a bounded number
    of words is remembered; long words cost n log n.
    """
    shared = _shared_definition(docs, path or tokenizer_path())

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder, values = _encoder(shared.value, digests), batch.column("text").to_pylist()
        if not digests:
            ids = encoder.encode(values)
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
        n, print_ids, print_text = [], [], []
        for words in encoder.entries(values):
            n.append(sum([e[0] for e in words]))
            print_ids.append(sha(" ".join([e[1] for e in words])))
            print_text.append(sha(" ".join([e[2] for e in words])))
        return [pa.array(n, pa.int64()), pa.array(print_ids, pa.string()), pa.array(print_text, pa.string())]

    digest = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return _with_columns(docs, text, run, digest if digests else [("ids", "array<int>"), ("n_tokens", "bigint")])


def bpe_decode(docs: DataFrame, *, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``: the token strings of ``ids`` joined by one space, as the file names no decoder; special
    tokens are kept, ids without token passed over. Null ids give a null, no ids an empty text."""
    shared = _shared_definition(docs, path or tokenizer_path())

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        decode = _encoder(shared.value).decode
        return [pa.array([None if x is None else decode(x) for x in batch.column("text").to_pylist()], pa.string())]

    return _with_columns(docs, ids, run, [("decoded", "string")])


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True).drop("text")


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
