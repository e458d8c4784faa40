"""Periodic runs, token alignment and SimHash against plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trustloom.llm import periodic_runs, registry, simhash, token_alignment
from trustloom.llm.bpe import tokenizer_path
from trustloom.llm.words import mix

SF_DIR = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, runs string, key int, id int, k int, n int, print string, label int, `a.b` int"


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(spark, texts):
    """Texts under an id of their own, some twice, some under a null id, with columns that clash."""
    rows = [(i, t, "x", 1, 2, 3, 4, "p", 5, 6) for i, t in enumerate(texts)]
    rows += [(None, *rows[k][1:]) for k in range(0, len(rows), 3)] + rows[:4]
    return spark.createDataFrame(rows, CLASH)


# ---- periodic runs


def plain_runs(words, min_exponent=4, min_length=6):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(
        (lo, hi - lo, q) for (lo, hi), q in found.items() if hi - lo >= max(min_length, min_exponent * q))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


repetitive = st.lists(
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 7)), max_size=4,
).map(lambda parts: [x for words, times in parts for x in words * times])


@settings(max_examples=150, deadline=None)
@given(st.lists(repetitive, max_size=5), st.sampled_from([1, 2, 5, 16, 1 << 16]), st.sampled_from([2, 3, 4]))
def test_runs_equal_plain_loop(texts, appended, exponent):
    first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    codes = mix(np.array([x + 9 for t in texts for x in t], dtype=np.uint64))
    before = periodic_runs.APPENDED
    try:
        periodic_runs.APPENDED = appended
        got = sorted((int(lo), int(hi - lo), int(q)) for q, lo, hi in periodic_runs.runs_of(codes, first, exponent))
    finally:
        periodic_runs.APPENDED = before
    want = [(lo + int(f), n, q) for t, f in zip(texts, first) for lo, n, q in plain_runs(t, exponent, 0)]
    assert got == sorted(want)


def test_runs_when_fingerprints_collide(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x % np.uint64(2))
    texts = [[1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 5], [2, 4] * 9, [1, 3, 5, 7, 9, 11]]
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = periodic_runs.runs_of(np.array(sum(texts, []), dtype=np.uint64), first, 4)
    assert sorted((int(lo), int(hi - lo), int(q)) for q, lo, hi in got) == [(0, 12, 3), (13, 18, 2)]


def test_runs_of_one_very_long_text():
    rng = np.random.default_rng(3)
    period = rng.integers(0, 1 << 40, 5_000).astype(np.uint64)
    words = np.r_[rng.integers(0, 1 << 40, 100_000).astype(np.uint64), np.tile(period, 9)[:-7], np.full(70_000, 5, dtype=np.uint64)]
    got = periodic_runs.runs_of(words, np.array([0, len(words)]), 4)
    assert got.tolist() == [[5_000, 100_000, 144_993], [1, 144_993, 214_993]]


def test_periodic_runs_of_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b a c", "a a " * 6,
             "la la la la la la b " * 5, "é ö " * 200 + "end", "one two three " * 3, "w" * 100_000 + " w"]
    df = odd_rows(spark, texts)
    got = periodic_runs.periodic_runs(df)
    assert sorted(got.columns) == sorted([*df.columns, "collapsed"])
    for r in got.collect():
        runs = plain_runs(words_of(r.text))
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(words_of(r.text), runs)
        assert r["a.b"] == 6 and r.key == 1
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in df.collect())
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, min_exponent=1)


def test_op11_equals_plain_loop(spark):
    query = registry.QUERIES["op11_periodic_runs"]
    got = {r.doc_id: r for r in query(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        words, h = words_of(doc.text), zlib.crc32(str(doc.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(words)
        r = got[doc.doc_id]
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == want and r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
    assert planted > 5


# ---- token alignment


PAIR, LIBRARY = [], []


def the_pair():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        return token_alignment.TokenizerPair(f.read(), g.read())


@pytest.fixture(scope="module")
def pair():
    return the_pair()


def odd_texts():
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdeé ß\n\t  .,'<|_中文🙂") for _ in range(n))
    return [
        None, "", " ", "  two  spaces  ", "<|endoftext|> and </s>", "don't we'll 's x's", "a▁b", "tab\tand\nline\r\n ",
        "naïve façade 中文字符 🙂🙂 ﬁ", "\x00 nul", "x" * 3_000, "ab " * 900, "word. " * 700 + "  " * 300 + "end",
        *(noise(n) for n in (5, 60, 700, 4_000, 9_000))]


def plain_groups(a, ends_a, b, ends_b):
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def unpacked(tokens):
    a, b, size_a, size_b = (np.frombuffer(x, dtype=np.int32).tolist() for x in tokens)
    up = [np.r_[0, np.cumsum(x)].astype(int).tolist() for x in (size_a, size_b)]
    return [(a[i:j], b[k:m]) for i, j, k, m in zip(up[0], up[0][1:], up[1], up[1][1:])]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abé '.,\n\t\u00a0\u3000中🙂") | st.just(" "), min_size=1, max_size=60),
       st.lists(st.integers(0, 120), min_size=3, max_size=3).map(sorted))
def test_fragments_are_a_monoid(text, cuts):
    pair = PAIR[0] if PAIR else PAIR.append(the_pair()) or PAIR[0]
    data = b" " + text.encode()
    w, x, y, z = (token_alignment.fragment(data[i:j], pair) for i, j in zip([0, *cuts], [*cuts, len(data)]))
    join = lambda p, q: token_alignment.compose(p, q, pair)
    whole = join(join(join(w, x), y), z)
    assert whole == join(w, join(x, join(y, z))) == join(join(w, x), join(y, z))
    assert join(token_alignment.EMPTY, x) == x == join(x, token_alignment.EMPTY)
    found = token_alignment.finished(whole, pair)
    want = plain_groups(*plain_tokens(pair, text))
    assert unpacked(found) == want if want else found is None


def plain_tokens(pair, text):
    """Token ids and ends of both, none if the text does not come back."""
    if not text:
        return [], [], [], []
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")) if not LIBRARY else LIBRARY[0]
    LIBRARY[:] = [library]
    library.encode_special_tokens = True
    a, b = library.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
        return [], [], [], []
    return a, np.cumsum([len(pair.bytes_a[i]) for i in a]).tolist(), b, np.cumsum([len(pair.bytes_b[i]) for i in b]).tolist()


def plain_scores(pair, texts):
    groups = [plain_groups(*plain_tokens(pair, t)) for t in texts]
    links = [[(a, b) for p, q in g for a in p for b in q] for g in groups]
    counts = Counter(x for found in links for x in set(found))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for g, found in zip(groups, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        yield (
            sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(found),
            sum(counts[x] == best[x[0]] for x in found), sum(counts[x] for x in found), sha(text) if g else "")


def score_rows(df):
    return Counter(tuple(r[c] for c in (
        "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


@pytest.mark.parametrize("chunk, fan_in, head", [(1 << 16, 8, 1 << 19), (64, 2, 10), (1_000, 3, 0)])
def test_alignment_equals_plain_loop(spark, pair, monkeypatch, chunk, fan_in, head):
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", 40 if head == 10 else 1 << 20)
    texts = odd_texts()
    df = odd_rows(spark, texts)
    linked = token_alignment.link_tokens(df, chunk_bytes=chunk, fan_in=fan_in)
    got = token_alignment.score_links(linked, token_alignment.count_links(linked), head_pairs=head)
    rows = df.collect()
    want = Counter((r.doc_id, *s) for r, s in zip(rows, plain_scores(pair, [r.text for r in rows])))
    assert score_rows(got) == want
    aligned = token_alignment.align_tokens(df, chunk_bytes=chunk, fan_in=fan_in).collect()
    groups = Counter(str((r.id, unpacked([np.array(x, dtype=np.int32).tobytes() for x in r[1:]]))) for r in aligned)
    assert groups == Counter(str((r.doc_id, plain_groups(*plain_tokens(pair, r.text)))) for r in rows)


def test_long_rows_by_ranges_of_ids(monkeypatch):
    rnd = random.Random(5)
    a, b = ([rnd.randint(0, 6) for _ in range(50)] for _ in range(2))
    sizes = [7, 13, 30]
    tokens = token_alignment.Tokens(*(np.array(x, dtype=np.int32).tobytes() for x in (a, b, sizes, sizes)))
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", 20)
    got, want, at = Counter(), Counter(), 0
    for _, pairs, weights in token_alignment.distinct_links(token_alignment.Groups([tokens])):
        assert not set(pairs.tolist()) & set(got)
        got.update(dict(zip(pairs.tolist(), weights.tolist())))
    for n in sizes:
        want.update((x << 32) + y for x in a[at : at + n] for y in b[at : at + n])
        at += n
    assert got == want


def test_alignment_of_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    linked = token_alignment.link_tokens(docs)
    assert token_alignment.score_links(linked, token_alignment.count_links(linked)).count() == 0
    assert token_alignment.align_tokens(docs).count() == 0


def test_op12_equals_plain_loop(spark, pair):
    got = registry.QUERIES["op12_token_alignment"](spark, SF_DIR).withColumnRenamed("doc_id", "id")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = Counter((r.doc_id, *s) for r, s in zip(docs, plain_scores(pair, [r.text for r in docs])))
    assert score_rows(got) == want


# ---- SimHash


def plain_print(text, size=3):
    words = words_of("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_classes(rows, radius=2):
    """Smallest id of the class by fingerprint."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= radius:
                root[find(p)] = find(q)
    least = {}
    for id, p in rows:
        r = find(p)
        least.setdefault(r, None)
        if id is not None:
            least[r] = id if least[r] is None else min(least[r], id)
    return {p: least[find(p)] for p in prints}


@pytest.mark.parametrize("segments, tile", [(4, 2_048), (4, 3), (8, 3), (16, 50)])
def test_links_of_tiles_equal_all_pairs(spark, segments, tile):
    rnd = random.Random(segments * 100 + tile)
    prints = {0, (1 << 64) - 1, 1, 1 << 63}
    for _ in range(60):
        p = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 3, 8])):
            prints.add(p)
            p ^= sum(1 << k for k in rnd.sample(range(64), rnd.choice([1, 2, 3])))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    links = simhash.near_links(df, len(prints), tile=tile, segments=segments).collect()
    linked = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links]
    assert all((a ^ b).bit_count() <= 64 for a, b in linked)
    want = plain_classes([(p, p) for p in prints])
    root = {p: p for p in prints}
    for _ in range(len(prints)):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert root == want


def test_classes_of_odd_rows(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "ONE", "one two", "É é", " ".join(base), " ".join(base[:-1]), " ".join(base).upper(),
             " ".join(base[:200] + ["x"] + base[200:]), "completely different words here", "a a a a a a", "w " * 100_000]
    df = odd_rows(spark, texts)
    rows = [(r.doc_id, plain_print(r.text)) for r in df.collect()]
    of = plain_classes(rows)
    for heavy in (2, 2_000):
        got = simhash.simhash_classes(df, heavy=heavy)
        assert got.columns == ["doc_id", "print", "class_id"]
        assert Counter((r.doc_id, r.print % (1 << 64), r.class_id) for r in got.collect()) == Counter((i, p, of[p]) for i, p in rows)
    alone = spark.createDataFrame([(None, "x y z")], "doc_id long, text string")
    assert simhash.simhash_classes(alone).first().class_id is None
    assert simhash.simhash_classes(df.limit(0)).count() == 0


def test_op13_equals_plain_loop(spark):
    got = registry.QUERIES["op13_simhash"](spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = [(r.doc_id, plain_print(r.text)) for r in docs]
    of = plain_classes(rows)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", of[p]) for i, p in rows)
    assert len(set(of.values())) < len(rows)
