"""Alignment of the tokens of two tokenizers, by fragments of byte ranges that compose, and how their tokens are linked."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.bpe import byte_letters, tokenizer_path
from trustloom.llm.rows import column, packed, table
from trustloom.llm.words import release, small_batches
from trustloom.session import materialise

BATCH_BYTES = 2 << 20
CHUNK_BYTES = 64 << 10
PART_BYTES = 16 << 20
FAN_IN = 8
LINKS_AT_ONCE = 1 << 20
HEAD_PAIRS = 1 << 19  # of 17 bytes each: 9 MB whatever the input
BUCKETS_PER_DOUBLING = 8
# How byte-level BPE parts a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ---- tokens


class Tokens(NamedTuple):
    """Tokens of both tokenizers in groups, as the bytes of 32-bit numbers: the ids of A and of B, and how many of each make
    up each group."""

    a: bytes
    b: bytes
    size_a: bytes
    size_b: bytes


NONE = Tokens(b"", b"", b"", b"")
_SPACE = 0x20


def joined(parts: list[Tokens]) -> Tokens:
    return Tokens(*map(b"".join, zip(*parts)))


def _sliced(data: bytes, counts: list[int]) -> list[bytes]:
    """Pieces of ``counts`` 32-bit numbers."""
    ends = [0, *accumulate(4 * n for n in counts)]
    return [data[x:y] for x, y in zip(ends, ends[1:])]


class TokenizerPair:
    """Tokenizer A (byte-level BPE) and B (pieces that begin with U+2581 for a space)."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_letters())}
        parts = json.loads(definition)["model"]
        entries = {i: bytes(map(byte.__getitem__, t)) for t, i in parts["vocab"].items() if all(c in byte for c in t)}
        merged = [parts["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in parts["merges"]]
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if merged != sorted(merged) or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("merges must be in the order of their ids, and no piece go on with a space")
        # Merging in the order of ids is then what the file says. Its special tokens are plain text here.
        self.a = tiktoken.Encoding(
            "a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in entries.items()}, special_tokens={})
        self.blank = pieces.index("▁")
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))

    def encoded(self, texts: list[str]) -> list[Tokens | None]:
        """The tokens of a space and each text; none if these do not give it back byte by byte. The texts are laid out one
        after the other, and groups are cut wherever tokens of both end."""
        data = [b" " + t.encode() for t in texts]
        lists_a = [self.a.encode_ordinary(f" {t}") for t in texts]
        lists_b = [ids or [self.blank] for ids in self.b.encode(texts, num_threads=1)]
        whole = [_gives(x, self.bytes_a) == d == _gives(y, self.bytes_b) for x, y, d in zip(lists_a, lists_b, data)]
        if not all(whole):
            good = iter(self.encoded([t for t, ok in zip(texts, whole) if ok]))
            return [next(good) if ok else None for ok in whole]
        if not texts:
            return []
        flat, ends, counts = [], [], []
        for lists, size in ((lists_a, self.size_a), (lists_b, self.size_b)):
            flat.append(np.fromiter(chain.from_iterable(lists), dtype=np.int32))
            ends.append(np.cumsum(size[flat[-1]]))
            counts.append([len(x) for x in lists])
        met = np.zeros(ends[0][-1] + 1, dtype=np.uint8)
        for x in ends:
            met[x] += 1
        cuts = [np.flatnonzero(met[x] == 2) + 1 for x in ends]
        text_ends = np.cumsum([len(d) for d in data])
        groups = np.diff(np.searchsorted(ends[0][cuts[0] - 1], text_ends, side="right"), prepend=0).tolist()
        parts = [*zip(flat, counts), *((np.diff(c, prepend=0).astype(np.int32), groups) for c in cuts)]
        return list(map(Tokens, *(_sliced(values.tobytes(), n) for values, n in parts)))


def _gives(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in ids])


_PAIRS: dict[str, TokenizerPair] = {}


def _pair(definition: str, model: bytes) -> TokenizerPair:
    """One pair per Python worker."""
    key = hashlib.sha1(definition.encode() + model).hexdigest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = TokenizerPair(definition, model)
    return _PAIRS[key]


# ---- fragments


class Fragment(NamedTuple):
    """What a byte range of a text (with the space before it) yields. A unit is a space and what follows it, up to the next
    space that stands behind a character other than white space. Both tokenizers always begin a token there, whatever
    stands around: A parts texts before white space that it does not take into a token, and no piece of B has a space
    behind another character. So a range yields the bytes up to its first unit (open prefix), the tokens of the whole units
    in it (closed groups), and the bytes from its last unit on, with which the next range may go on (open suffix). A range
    without the beginning of a unit is all prefix, and ``closed`` is none. ``ok`` is false once there are no tokens."""

    prefix: bytes
    closed: Tokens | None
    suffix: bytes
    ok: bool = True


EMPTY = Fragment(b"", None, b"")
BROKEN = Fragment(b"", NONE, b"", False)


def unit_starts(data: bytes) -> list[int]:
    """Where units begin for certain, the start of ``data`` left out: at a space behind an ASCII character that is no white
    space, or behind the last byte of another character that is none."""
    x = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(x[1:] == _SPACE) + 1
    before = x[at - 1]
    sure = (before > _SPACE) & (before < 0x7F)
    wide = np.flatnonzero((before >= 0x80) & (at >= 2))
    # Second last bytes of every wide character that Unicode takes for white space, and of U+2581.
    sure[wide] = ~np.isin(x[at[wide] - 2], (0xC2, 0x80, 0x81, 0x9A, 0x96))
    return at[sure].tolist()


def compose(x: Fragment, y: Fragment, pair: TokenizerPair) -> Fragment:
    """The fragment of both ranges, ``y`` following ``x``. Associative, with ``EMPTY`` as neutral element: units that reach
    over the seam are closed here."""
    if not (x.ok and y.ok):
        return BROKEN
    seam = (x.prefix if x.closed is None else x.suffix) + y.prefix
    starts = unit_starts(seam)
    if not starts and (x.closed is None or y.closed is None):
        return Fragment(seam, y.closed, y.suffix) if x.closed is None else Fragment(x.prefix, x.closed, seam)
    # Between the first and the last start, or a side that is closed, there are whole units.
    first, last = (starts[0] if x.closed is None else 0), (starts[-1] if y.closed is None else len(seam))
    (tokens,) = pair.encoded([seam[first + 1 : last].decode()]) if last > first else (NONE,)
    if tokens is None:
        return BROKEN
    return Fragment(
        seam[:first] if x.closed is None else x.prefix, joined([x.closed or NONE, tokens, y.closed or NONE]),
        seam[last:] if y.closed is None else y.suffix)


def fragment(data: bytes, pair: TokenizerPair) -> Fragment:
    return compose(EMPTY, Fragment(data, None, b""), pair)


def finished(x: Fragment, pair: TokenizerPair) -> Tokens | None:
    """The tokens of a whole text, whose first unit begins where it does and whose last one ends where it does."""
    if not x.ok:
        return None
    first, last = (pair.encoded([data[1:].decode()])[0] if data else NONE for data in (x.prefix, x.suffix))
    return None if first is None or last is None else joined([first, x.closed or NONE, last])


# ---- over Spark


_LISTS = Tokens._fields
_KEYS = [("key", pa.int64()), ("id", pa.int64()), ("k", pa.int32()), ("n", pa.int32())]
_RANGE = pa.schema([*_KEYS, ("data", pa.binary())])
_FRAGMENT = pa.schema([
    *_KEYS, ("ok", pa.bool_()), ("cut", pa.bool_()), ("prefix", pa.binary()), ("suffix", pa.binary()),
    *((name, pa.binary()) for name in _LISTS)])
_ALIGNED = pa.schema([("id", pa.int64()), *((name, pa.list_(pa.int32())) for name in _LISTS)])
RANGE = "key bigint, id bigint, k int, n int, data binary"
FRAGMENT = "key bigint, id bigint, k int, n int, ok boolean, cut boolean, prefix binary, suffix binary, " + ", ".join(
    f"{name} binary" for name in _LISTS)
ALIGNED = "id bigint, " + ", ".join(f"{name} array<int>" for name in _LISTS)


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, id, text in zip(*(batch.column(c) for c in ("key", "id", "text"))):
                data = b" " + text.as_py().encode()
                n = -(-len(data) // size)
                for k in range(n):
                    yield pa.record_batch(
                        [[key.as_py()], [id.as_py()], [k], [n], [data[k * size : (k + 1) * size]]], schema=_RANGE)

    return run


def _fragment_row(row: dict, k: int, x: Fragment) -> dict:
    return {
        **{c: row[c] for c in ("key", "id", "n")}, "k": k, "ok": x.ok, "cut": x.closed is not None, "prefix": x.prefix,
        "suffix": x.suffix, **(x.closed or NONE)._asdict()}


def _fragment_of(row: dict) -> Fragment:
    closed = Tokens(*(row[c] for c in _LISTS)) if row["cut"] else None
    return Fragment(row["prefix"], closed, row["suffix"], row["ok"])


def _ranged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*shared.value)
        for batch in small_batches(batches, "data", BATCH_BYTES):
            rows = [_fragment_row(r, r["k"], fragment(r["data"], pair)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_FRAGMENT)

    return run


def _composed(shared, fan_in: int):
    def run(rows: pa.Table) -> pa.Table:
        pair = _pair(*shared.value)
        rows = rows.sort_by("k").to_pylist()
        whole = reduce(lambda x, y: compose(x, y, pair), map(_fragment_of, rows))
        return pa.Table.from_pylist([_fragment_row(rows[0], rows[0]["k"] // fan_in, whole)], schema=_FRAGMENT)

    return run


def _whole(shared, made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*shared.value)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            found = iter(pair.encoded([t for t in texts if t]))
            yield from made(batch.column("key"), batch.column("id"), [next(found) or NONE if t else NONE for t in texts])

    return run


def _closed(shared, made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*shared.value)
        for batch in batches:
            tokens = [finished(_fragment_of(r), pair) or NONE for r in batch.to_pylist()]
            yield from made(batch.column("key"), batch.column("id"), tokens)

    return run


def _tokenised(
    docs: DataFrame, id: str, text: str, path_a: str | None, path_b: str | None, chunk_bytes: int, fan_in: int, made,
    schema: str,
) -> DataFrame:
    """What ``made(keys, ids, tokens)`` makes of the tokens of the texts.

    A text of up to ``chunk_bytes`` is taken whole and never leaves its task. A longer one is cut into byte ranges that go
    to tasks of their own, where each becomes a fragment; fragments compose, ``fan_in`` neighbours at a time, to that of the
    whole text, whatever the number of ranges."""
    with open(path_a or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, \
            open(path_b or tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # a few MB whatever the input
    source = packed(docs).select(
        F.monotonically_increasing_id().alias("key"), column(id, "row").cast("long").alias("id"),
        column(text, "row").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = source.where(size <= chunk_bytes).mapInArrow(_whole(shared, made), schema)
    total, longest = source.where(size > chunk_bytes).agg(F.sum(size), F.max(size)).first()
    if not total:
        return rows
    ranges = source.where(size > chunk_bytes).mapInArrow(_cut(chunk_bytes), RANGE)
    parts = ranges.repartition(-(-total // PART_BYTES), "key", "k").mapInArrow(_ranged(shared), FRAGMENT)
    left = -(-(longest + 1) // chunk_bytes)
    while left > 1:
        parts = parts.groupBy("key", F.floor(F.col("k") / fan_in)).applyInArrow(_composed(shared, fan_in), FRAGMENT)
        left = -(-left // fan_in)
    return rows.unionByName(parts.mapInArrow(_closed(shared, made), schema))


def _aligned_rows(keys: pa.Array, ids: pa.Array, tokens: list[Tokens]) -> Iterator[pa.RecordBatch]:
    lists = []
    for data in zip(*tokens):
        offsets = np.r_[0, np.cumsum([len(x) // 4 for x in data])].astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), dtype=np.int32))))
    if lists:
        yield pa.record_batch([ids, *lists], schema=_ALIGNED)


def align_tokens(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
    chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, the token ids ``a`` and ``b`` (array<int>) of a space and the text, and how many of
    them, ``size_a`` and ``size_b`` (array<int>), make up each group: the bytes between two places where tokens of both end.

    Strings of special tokens are plain text. Null and empty texts, and texts that the tokens of A or B do not give back
    byte by byte, have no tokens. Very long texts are cut into ranges of ``chunk_bytes`` for as many tasks. Each row stands
    for itself, so ties, repeated rows and null ids play no part; neither do other columns.
    """
    return _tokenised(docs, id, text, path_a, path_b, chunk_bytes, fan_in, _aligned_rows, ALIGNED)


# ---- links


class Groups:
    """The groups of some texts, one after the other."""

    def __init__(self, tokens: list[Tokens]):
        def flat(data):
            return np.frombuffer(b"".join(data), dtype=np.int32), np.r_[0, np.cumsum([len(x) // 4 for x in data])].astype(np.int64)

        a, b, size_a, size_b = zip(*tokens) if tokens else ((),) * 4
        (self.a, self.first_a), (self.b, self.first_b) = flat(a), flat(b)
        (self.size_a, self.first), (self.size_b, _) = flat(size_a), flat(size_b)
        self.size_a, self.size_b = self.size_a.astype(np.int64), self.size_b.astype(np.int64)
        self.row = np.repeat(np.arange(len(tokens)), np.diff(self.first))

    def per_row(self, values: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(values)]
        return sums[self.first[1:]] - sums[self.first[:-1]]


def _products(left: np.ndarray, group: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``left`` (its group is ``group``) every place of its group in ``right``, which holds ``size`` a group:
    the place in ``left`` and the place in ``right``."""
    n = size[group]
    begin = np.r_[0, np.cumsum(size)][group]
    at = np.repeat(np.arange(len(left)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[at]


def _sorted_pairs(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, weight): each pair of a row once, with how often it is there. A pair is a * 2^32 + b."""
    bits_b, bits_a = (int(x.max(initial=0)).bit_length() for x in (b, a))
    if int(row.max(initial=0)).bit_length() + bits_a + bits_b > 63:
        (of_a, a), (of_b, b) = (np.unique(x, return_inverse=True) for x in (a, b))
        rows, codes, weight = _sorted_pairs(row, a, b)
        return rows, (of_a[codes >> 32] << 32) | of_b[codes & 0xFFFFFFFF], weight
    keys = np.sort((((row << bits_a) | a) << bits_b) | b)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    found = keys[starts]
    pairs = ((found >> bits_b) & ((1 << bits_a) - 1)) << 32 | (found & ((1 << bits_b) - 1))
    return found >> (bits_a + bits_b), pairs, np.diff(np.r_[starts, len(keys)])


def distinct_links(groups: Groups) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, pair, weight): each id pair that a row links, once, with how often it does. A pair is a * 2^32 + b. In pieces
    of about ``LINKS_AT_ONCE`` links, if need be of a range of A ids within one row."""
    links = groups.per_row(groups.size_a * groups.size_b)
    total = np.cumsum(links)
    at = 0
    while at < len(links):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + LINKS_AT_ONCE, side="right")))
        g = slice(groups.first[at], groups.first[to])
        a = groups.a[groups.first_a[at] : groups.first_a[to]].astype(np.int64)
        b = groups.b[groups.first_b[at] : groups.first_b[to]].astype(np.int64)
        size_a, size_b = groups.size_a[g], groups.size_b[g]
        of_a, of_b = (np.repeat(np.arange(len(s)), s) for s in (size_a, size_b))
        if total[to - 1] - base <= LINKS_AT_ONCE:
            i, j = _products(a, of_a, b, size_b)
            if len(i):
                row, pairs, weight = _sorted_pairs(groups.row[g][of_a[i]] - at, a[i], b[j])
                yield row + at, pairs, weight
        else:
            yield from ((np.full(len(p), at), p, w) for p, w in _long_row(a, of_a, b, of_b, len(size_a)))
        at = to


def _long_row(a, of_a, b, of_b, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs and weights of one row: equal ids of a group count as one with a weight, and A ids go by ranges."""
    (a, of_a, times_a), (b, of_b, times_b) = (
        (keys & 0xFFFFFFFF, keys >> 32, times) for keys, times in (
            np.unique((of << 32) | ids, return_counts=True) for ids, of in ((a, of_a), (b, of_b))))
    size_b = np.bincount(of_b, minlength=n)
    order = np.argsort(a, kind="stable")
    a, of_a, times_a = a[order], of_a[order], times_a[order]
    total = np.cumsum(size_b[of_a])
    at = 0
    while at < len(a):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + LINKS_AT_ONCE, side="right")))
        to = max(int(np.searchsorted(a, a[to - 1], side="left")), int(np.searchsorted(a, a[at], side="right")))
        i, j = _products(a[at:to], of_a[at:to], b, size_b)
        pairs, inverse = np.unique((a[at:to][i] << 32) | b[j], return_inverse=True)
        weights = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(weights, inverse, times_a[at:to][i] * times_b[j])
        yield pairs, weights
        at = to


class _Strings:
    """Decimal ids with the sign that follows them."""

    def __init__(self, last: str):
        self.last, self.known = last, []

    def of(self, ids: np.ndarray, ends_group: np.ndarray) -> list[str]:
        for i in range(len(self.known) // 2, int(ids.max(initial=-1)) + 1):
            self.known += (f"{i},", f"{i}{self.last}")
        return list(map(self.known.__getitem__, (2 * ids.astype(np.int64) + ends_group).tolist()))


_A, _B = _Strings("|"), _Strings(";")


def _digests(groups: Groups) -> list[str]:
    """Per row the SHA-256 of its groups, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    up_a, up_b = np.cumsum(groups.size_a), np.cumsum(groups.size_b)
    last_a, last_b = np.zeros(len(groups.a), dtype=bool), np.zeros(len(groups.b), dtype=bool)
    last_a[up_a - 1] = True
    last_b[up_b - 1] = True
    strings = np.empty(len(last_a) + len(last_b), dtype=object)
    strings[np.arange(len(last_a)) + np.repeat(up_b - groups.size_b, groups.size_a)] = _A.of(groups.a, last_a)
    strings[np.arange(len(last_b)) + np.repeat(up_a, groups.size_b)] = _B.of(groups.b, last_b)
    first = (groups.first_a + groups.first_b).tolist()
    return [
        hashlib.sha256("".join(strings[x:y].tolist())[:-1].encode()).hexdigest() if y > x else ""
        for x, y in zip(first, first[1:])]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_LINKED = pa.schema([
    ("key", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in _COUNTS),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("weights", pa.binary())])
LINKED = "key bigint, id bigint, piece int, " + ", ".join(f"{c} bigint" for c in _COUNTS) + \
    ", groups_sha256 string, pairs binary, weights binary"


def _linked_rows(keys: pa.Array, ids: pa.Array, tokens: list[Tokens]) -> Iterator[pa.RecordBatch]:
    groups = Groups(tokens)
    n = len(tokens)
    pairs, weights = ([b""] * n for _ in range(2))
    for row, pair, weight in distinct_links(groups):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(row)]):
            at, data = int(row[x]), (pair[x:y].tobytes(), weight[x:y].tobytes())
            if pairs[at]:  # a further piece of a row with very many links
                zero, none = pa.array([0]), pa.nulls(1, pa.string())
                yield pa.record_batch(
                    [keys[at : at + 1], ids[at : at + 1], [1], zero, zero, zero, zero, none, [data[0]], [data[1]]],
                    schema=_LINKED)
            else:
                pairs[at], weights[at] = data
    counts = [np.diff(groups.first_a), np.diff(groups.first_b), np.diff(groups.first), groups.per_row(groups.size_a * groups.size_b)]
    yield pa.record_batch(
        [keys, ids, pa.array(np.zeros(n, dtype=np.int32)), *map(pa.array, counts), pa.array(_digests(groups), pa.string()),
         pa.array(pairs, pa.binary()), pa.array(weights, pa.binary())], schema=_LINKED)


def link_tokens(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
    chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN,
) -> DataFrame:
    """What the tokens that ``align_tokens`` finds are linked to: every A token of a group with every B token of it. Per row
    of ``docs`` the numbers of tokens, groups and links, ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``, the ids of each group;
    empty without tokens), and each pair of ids once, a * 2^32 + b, with how often it is linked (``pairs`` and ``weights``,
    64-bit numbers). A written table. Where a text has very many links its pairs take further rows (``piece`` 1)."""
    rows = _tokenised(docs, id, text, path_a, path_b, chunk_bytes, fan_in, _linked_rows, LINKED)
    return materialise(rows, "linked")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time with their row numbers, pairs and weights."""
    for part in small_batches(batches, "pairs", 8 * LINKS_AT_ONCE):
        pairs, weights = (
            np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.int64) for c in ("pairs", "weights"))
        n = [len(x) // 8 for x in part.column("pairs").to_pylist()]
        yield part, np.repeat(np.arange(part.num_rows), n), pairs, weights


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, pairs, _ in _pieces(batches):
        pairs, n = np.unique(pairs, return_counts=True)
        yield pa.record_batch([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def count_links(linked: DataFrame) -> DataFrame:
    """(pair, n, best): for each pair of ids that any row links how many rows do, and whether no other pair of its A id is
    linked in more. A written table. Counts are combined in the tasks and again before the shuffle."""
    rows = linked.select("pairs", "weights").mapInArrow(_counted, "pair bigint, n bigint")
    counts = materialise(rows.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most as many rows as A has tokens
    flagged = counts.withColumn("a", a).join(F.broadcast(most), "a")
    return materialise(flagged.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


_SCORED = pa.schema([(c, pa.int64()) for c in ("key", "id", "pair", "piece", *_COUNTS, "n_best", "count_sum")] + [
    ("groups_sha256", pa.string())])
SCORED = "key bigint, id bigint, pair bigint, piece bigint, " + ", ".join(
    f"{c} bigint" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, bests = shared.value
        for part, row, pairs, weights in _pieces(batches):
            place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            hit = known[place] == pairs
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            sums = (np.r_[0, np.cumsum(np.where(hit, weights * x[place], 0))] for x in (bests, counts))
            n_best, count_sum = (pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums)
            yield pa.record_batch([
                part.column("key"), part.column("id"), pa.nulls(part.num_rows, pa.int64()),
                part.column("piece").cast(pa.int64()), *(part.column(c) for c in _COUNTS), n_best, count_sum,
                part.column("groups_sha256")], schema=_SCORED)
            if not hit.all():  # looked up by a join; the weight stands in the place of the links
                n = int((~hit).sum())
                none = pa.nulls(n, pa.int64())
                yield pa.record_batch([
                    part.column("key").take(pa.array(row[~hit])), none, pa.array(pairs[~hit]), none, none, none, none,
                    pa.array(weights[~hit]), none, none, pa.nulls(n, pa.string())], schema=_SCORED)
        release()

    return run


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, DataFrame]:
    """The most frequent pairs, at most ``most``, as sorted arrays, and the others as a table. Where to part them is read
    off a histogram of the counts, a few hundred numbers."""
    bucket = F.floor(F.log2("n") * BUCKETS_PER_DOUBLING)
    room, lowest = most, None
    for b, n in sorted(counts.groupBy(bucket.alias("b")).count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        lowest = b
    head = counts.where(bucket >= lowest if lowest is not None else F.lit(False)).toArrow().sort_by("pair")
    arrays = tuple(head.column(c).to_numpy() for c in ("pair", "n", "best"))
    if not len(arrays[0]):
        arrays = np.array([-1]), np.array([0]), np.array([False])
    return arrays, counts.where(bucket < lowest) if lowest is not None else counts


def score_links(linked: DataFrame, counts: DataFrame, *, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Per document of ``linked``: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is a best
    one of ``counts``), ``count_sum`` (the counts of all links) and ``groups_sha256``. Documents without tokens have zeros.

    The ``head_pairs`` most frequent pairs are known to every task, and serve nearly all links there. The pairs of a row
    that are not among them go to a join with the rest of ``counts``; a pair that many rows link is never among these.
    """
    arrays, rest = _frequent(counts, head_pairs)
    shared = linked.sparkSession.sparkContext.broadcast(arrays)
    scored = materialise(linked.mapInArrow(_scored(shared), SCORED), "link-scores")
    met = scored.where(F.col("pair").isNotNull()).select("key", "pair", F.col("n_links").alias("weight")).join(rest, "pair")
    late = met.select(
        "key", F.when(F.col("best"), F.col("weight")).otherwise(0).alias("best"), (F.col("weight") * F.col("n")).alias("sum"))
    more = scored.where(F.col("piece") > 0).select("key", F.col("n_best").alias("best"), F.col("count_sum").alias("sum"))
    late = late.unionByName(more).groupBy("key").agg(F.sum("best").alias("late_best"), F.sum("sum").alias("late_sum"))
    rows = scored.where(F.col("piece") == 0).join(late, "key", "left")
    return rows.select(
        "id", *_COUNTS, (F.col("n_best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("late_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    linked = link_tokens(table(spark, sf_dir, "documents"))
    return score_links(linked, count_links(linked)).withColumnRenamed("id", "doc_id")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
