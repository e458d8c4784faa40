"""The operators on documents, against plain loops and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trustloom.llm import bpe, decontaminate, language, line_dedup, near_dedup, quality, sharding, substring_dedup
from trustloom.llm.words import LOWER_WORDS, split_words, window_prints

DOCS = "doc_id long, text string, source string, row string, n long, words string, at string, id string, print string"


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def odd(spark, texts):
    """Documents with nulls, empty and long texts, repeated rows and columns named like inner ones."""
    rows = [(i, t, f"s{i % 3}", "r", 1, "w", "a", "i", "p") for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None, None, None, None, None), (900, None, "s1", "r", 1, "w", "a", "i", "p")]
    rows += [(901, "", "s1", "r", 1, "w", "a", "i", "p"), (902, " \n\t ", "s1", "r", 1, "w", "a", "i", "p")]
    rows += [(903, "word " * 20_000, "s1", "r", 1, "w", "a", "i", "p"), (904, "ä" * 50_000, "s2", "r", 1, "w", "a", "i", "p")]
    rows += [(905, "twice the same row", "s2", "r", 1, "w", "a", "i", "p")] * 2
    return spark.createDataFrame(rows, DOCS)


def texts(seed, n, vocabulary=300, words=120):
    rnd = random.Random(seed)
    return [" ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randrange(words))) for _ in range(n)]


# ---- line dedup


def lines_by_loop(rows, ratio, least):
    pages, total = defaultdict(Counter), Counter()
    for _, text, host in rows:
        if host is not None:
            total[host] += 1
            pages[host].update({x.strip(" ") for x in (text.split("\n") if text is not None else [])} - {""})
    out = []
    for key, text, host in rows:
        lines = text.split("\n") if text is not None else []
        bad = {x for x, n in pages[host].items() if n >= least and n > ratio * total[host]} if host is not None else set()
        kept = [x for x in lines if x.strip(" ") == "" or x.strip(" ") not in bad]
        out.append((key, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_line_dedup_equals_loop(spark, broadcast_lines):
    rnd = random.Random(1)
    rows = [
        (i, "\n".join(rnd.choice(["menu", " menu", "footer", "", f"line {rnd.randrange(40)}"]) for _ in range(6)),
         rnd.choice(["a", "a", "b", None])) for i in range(200)]
    rows += [(500, None, "a"), (501, "", "a"), (502, "menu", "lonely"), (502, "menu", "lonely"), (None, "menu\nx", "a")]
    got = line_dedup.line_dedup(frame(spark, rows), max_ratio=0.3, min_pages=5, broadcast_lines=broadcast_lines)
    got = sorted((tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_dropped")) for r in got.collect()), key=str)
    assert got == lines_by_loop(rows, 0.3, 5)


def test_line_dedup_odd_rows(spark):
    docs = odd(spark, texts(2, 20))
    got = line_dedup.line_dedup(docs)
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# ---- decontamination


def hits_by_loop(docs, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if c.isascii() else c for c in t or ""))
    windows = defaultdict(set)
    for item, text in items:
        ws = cut(text)
        for s in range(max(1, len(ws) - size + 1) if ws else 0):
            windows[tuple(ws[s : s + size])].add(str(item))
    out = []
    for key, text in docs:
        ws, hit, found = cut(text), set(), set()
        for length in {len(w) for w in windows}:
            for s in range(len(ws) - length + 1):
                names = windows.get(tuple(ws[s : s + length]))
                if names:
                    hit.update(range(s, s + length))
                    found |= names
        out.append((key, len(ws), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_windows", [100_000, 7])
def test_decontaminate_equals_loop(spark, block_windows):
    body = texts(3, 60)
    items = [(i, t) for i, t in enumerate([body[0][:200], "The END", "w1", "ÉÈ x", None, "...", body[1][20:150], body[1][20:150]])]
    rows = [(i, t) for i, t in enumerate(body)] + [(100, body[2] + " THE-end " + body[0]), (101, "éÈ x"), (102, "ÉÈ, X")]
    rows += [(103, None), (104, ""), (105, "the end"), (105, "the end"), (None, "w1 w1")]
    got = decontaminate.decontaminate(
        frame(spark, rows, "doc_id long, text string"), frame(spark, items, "item_id long, text string"),
        block_windows=block_windows)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()), key=str)
    assert got == hits_by_loop(rows, items)


def test_decontaminate_odd_rows(spark):
    docs, none = odd(spark, texts(4, 5)), frame(spark, [], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.decontaminate(docs.limit(0), frame(spark, [(1, "a b")], "item_id long, text string")).count() == 0


# ---- sharding


@pytest.mark.parametrize("rows_per_block", [100_000, 10])
def test_shards_are_exact_and_keep_rows(spark, tmp_path, rows_per_block):
    odd(spark, texts(5, 400)).repartition(7).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = sharding.shard_rows(docs, shards=5, order_by=("doc_id", "text"), rows_per_block=rows_per_block)
    rows = got.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    n = docs.count()
    assert sorted(len(v) for v in by.values()) == sorted(n // 5 + (s < n % 5) for s in range(5))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter(tuple(r[c] for c in docs.columns) for r in rows) == Counter(map(tuple, docs.collect()))
    again = sharding.shard_rows(docs, shards=5, order_by=("doc_id", "text"), rows_per_block=rows_per_block)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
    assert sharding.shard_rows(docs.limit(0), shards=5, order_by=("doc_id",)).count() == 0


def test_matrix_follows_the_hypergeometric_law(spark):
    parts = spark.range(400).select(F.col("id").cast("int").alias("p"), F.lit(50).cast("long").alias("n"))
    counts = [r.upto for r in sharding.communication_matrix(parts, 20_000, 400, 4, 5).collect()]
    first = np.array([u[0] for u in counts])
    assert all(u[-1] == 50 for u in counts) and first.sum() == 5_000
    expected = 50 * 0.25 * 0.75 * (20_000 - 50) / 19_999
    assert abs(first.var() - expected) < 0.25 * expected


def test_hypergeometric_is_exact_on_small_numbers(spark):
    u = (F.col("id") + 0.5) / 2000
    draw = sharding.hypergeometric(u, F.lit(10).cast("long"), F.lit(4).cast("long"), F.lit(3).cast("long"))
    seen = Counter(r[0] for r in spark.range(2000).select(draw).collect())
    assert [round(seen[k] / 2000, 3) for k in range(4)] == pytest.approx([20 / 120, 60 / 120, 36 / 120, 4 / 120], abs=2e-3)


# ---- byte pairs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_equals_library(spark, library):
    rnd = random.Random(6)
    alphabet = "aaabbbabcdeinthersou'’éÉßİΣς 12٣<|>startoftextendoftext\n\t ​🙂漢字é_͸࢏"
    body = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    body += ["<|endoftext|>", "a<|startoftext|>b", "a" * 5000, "ab" * 3000, "the" * 3000, "it's they're", "   ", "ΑΣ ΑΣ."]
    docs = odd(spark, body)
    coded = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert len(coded) == docs.count()
    for r in coded:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for a, b in zip(sorted(coded, key=str), sorted(bpe.bpe_encode(docs, digests=True).collect(), key=str)):
        assert (sha(" ".join(map(str, a.ids))), sha(a.decoded)) in {(b.ids_sha256, b.decoded_sha256)} or a.doc_id != b.doc_id
    assert bpe.bpe_encode(docs.limit(0)).count() == 0


def test_merge_that_makes_a_lower_rank_goes_first():
    class Toy:
        ids = {"a": 0, "b": 1, "ab": 2, "aba": 3}
        size, inner, last = 4, {97: 0, 98: 1}, {97: 0, 98: 1}
        merge = [(2, 0, 3), (0, 1, 2)]
        rank_of = {2 * 4 + 0: 0, 0 * 4 + 1: 1}

    assert bpe.merge_words(["abab"], Toy) == [[3, 1]]


# ---- repeated passages


def repeats_by_loop(rows, size):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in enumerate(rows)}
    key = lambda i: float("inf") if rows[i][0] is None else rows[i][0]
    first = {}
    for i, ws in cut.items():
        for s in range(len(ws) - size + 1):
            w = tuple(ws[s : s + size])
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, ws in cut.items():
        gone = {p for s in range(len(ws) - size + 1) if first[tuple(ws[s : s + size])] < key(i) for p in range(s, s + size)}
        out.append((rows[i][0], len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_entries, batch_bytes, fan, shared", [
    (1_000_000, 6 << 20, 1_024, 100_000), (50, 500, 1_024, 0), (1_000_000, 500, 2, 0), (50, 6 << 20, 2, 100_000), (20, 500, 3, 1)])
def test_repeats_equal_loop(spark, monkeypatch, bucket_entries, batch_bytes, fan, shared):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch_bytes)
    rnd = random.Random(7)
    body, passages = texts(8, 60), [" ".join(f"p{rnd.randrange(50)}" for _ in range(n)) for n in (9, 10, 11, 23, 40)]
    rows = []
    for i, t in enumerate(body):
        ws = t.split()
        for p in rnd.sample(passages, rnd.randrange(3)):
            at = rnd.randrange(len(ws) + 1)
            ws[at:at] = p.split()
        rows.append((rnd.randrange(10_000), "\t ".join(ws)))
    rows += [(20_000, body[0]), (20_000, body[0]), (20_001, "x " * 60), (20_002, "x " * 45), (30_000, None), (30_001, "")]
    rows += [(None, body[1]), (None, " ".join(passages[-1].split()))]
    got = substring_dedup.remove_repeats(
        frame(spark, rows, "doc_id long, text string"), window=10, bucket_entries=bucket_entries, part_bytes=2_000, fan=fan,
        shared_ids=shared)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str)
    assert got == repeats_by_loop(rows, 10)


def test_repeats_of_negative_ids_in_many_parts(spark):
    rnd = random.Random(24)
    passages = [" ".join(f"p{rnd.randrange(50)}" for _ in range(n)) for n in (10, 15, 30)]
    ids = [rnd.randrange(-(1 << 62), 1 << 62) for _ in range(60)] + rnd.sample(range(-50, 50), 40)
    rows = [(i, f"{t} {rnd.choice(passages)} {t[:9]}") for i, t in zip(ids, texts(25, 100))] + [(None, passages[0])]
    got = substring_dedup.remove_repeats(
        frame(spark, rows, "doc_id long, text string"), window=10, bucket_entries=50, part_bytes=1_000)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str)
    assert got == repeats_by_loop(rows, 10)


def test_settled_repeats_of_equal_batches_spread_over_buckets(spark):
    copies = frame(spark, [(None, " ".join(f"w{i}" for i in range(60)))] * 4_000, "doc_id long, text string")
    source = copies.selectExpr("9 AS id", "text", "xxhash64(text) AS salt").repartition(80)
    found = source.mapInArrow(substring_dedup._anchor_entries(50, 40, 1), substring_dedup._ENTRIES)
    settled = [r.key for r in found.where("done").select("key").collect()]
    assert len(settled) == 80 and max(Counter(settled).values()) <= 12
    pieces = substring_dedup.dealt(5 * substring_dedup.SETTLED_ENTRIES, 3, 1_000)
    assert len(set(pieces.tolist())) > 3


def test_repeats_of_rows_without_id_stay_apart(spark, monkeypatch):
    """Texts whose 32-bit hashes are equal: the second of them shares no word with any other."""
    from pyspark.sql import functions as sf

    monkeypatch.setattr(sf, "hash", lambda *columns: sf.lit(7))
    passage = " ".join(f"a{i}" for i in range(60))
    rows = [(1, f"{passage} tail"), (None, passage), (None, " ".join(f"b{i}" for i in range(60)))]
    got = substring_dedup.remove_repeats(frame(spark, rows, "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(60, 0), (60, 60), (61, 0)]


def test_copies_without_id_are_taken_once(spark):
    passage = " ".join(f"a{i}" for i in range(60))
    rows = [(None, passage)] * 2_500 + [(5, passage), (3, f"x {passage}"), (9, "other words")]
    got = substring_dedup.remove_repeats(frame(spark, rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept) for r in got) == Counter(
        {(None, 60, ""): 2_500, (5, 60, ""): 1, (3, 0, f"x {passage}"): 1, (9, 0, "other words"): 1})


def test_packed_rows_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 2_000)
    counts = []
    for n in (100, 200, 400):
        rows = frame(spark, [(i, t) for i, t in enumerate(texts(31, n))], "id long, text string").repartition(4)
        source = rows.selectExpr("id", "text", "id AS salt")
        buckets = n // 2
        steps = substring_dedup.widths(buckets, 4)
        packed = source.mapInArrow(substring_dedup._anchor_entries(10, buckets, steps[0]), substring_dedup._ENTRIES).cache()
        made = [packed.count()]
        for width, narrower in zip(steps, steps[1:]):
            packed = packed.repartition("key").sortWithinPartitions("key").mapInArrow(
                substring_dedup._regrouped(width, narrower, ("uint32",), True, 500), substring_dedup._ENTRIES).cache()
            made.append(packed.count())
        assert {r.key for r in packed.select("key").distinct().collect()} <= set(range(buckets))
        counts.append(max(made))
    assert counts[1] < 2.6 * counts[0] and counts[2] < 2.6 * counts[1]


def test_repeats_odd_rows(spark):
    docs = odd(spark, texts(9, 10))
    assert substring_dedup.remove_repeats(docs).count() == docs.count()
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


# ---- near copies


def test_signatures_of_a_batch_equal_those_of_each_text():
    rnd = random.Random(33)
    body = texts(34, 40) + ["", "a", "a b", "a b c d", "a a a a a a a a a", None, "é ü ö ß x"]
    words = split_words(pa.array(body), LOWER_WORDS)
    doc, ids, counts = near_dedup.batch_shingles(words.print, words.first, 5)
    found = near_dedup.prob_min_hashes(doc, ids, counts, len(body), 24)
    prints = [near_dedup.text_prints(words.print, words.first, w) for w in (0, 1)]
    for i in rnd.sample(range(len(body)), len(body)):
        own = words.print[words.first[i] : words.first[i + 1]]
        a, x = near_dedup.shingles(own, 5)
        assert np.array_equal(ids[doc == i], a) and np.array_equal(counts[doc == i], x)
        assert np.array_equal(found[i], near_dedup.prob_min_hash(a, x, 24))
        for which, whole in enumerate(prints):
            assert whole[i] == (window_prints(own, len(own), which)[0] if len(own) else 0)


def similarity(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y))


def classes_by_loop(rows):
    sets = {}
    for key, text in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        sets[key] = Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a].keys() & sets[b].keys()) * 2 > max(len(sets[a]), len(sets[b])) and similarity(sets[a], sets[b]) >= 0.8 - 1e-9:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {k: find(k) for k in sets}


def near_rows():
    rnd, rows = random.Random(10), []
    for base in texts(11, 25, vocabulary=2000, words=150):
        ws = base.split()
        rows.append(ws)
        for _ in range(rnd.choice([0, 0, 1, 3, 12])):
            copy = list(ws)
            for _ in range(rnd.randrange(6)):
                if copy:
                    copy[rnd.randrange(len(copy))] = f"edit{rnd.randrange(10**6)}"
            rows.append(copy)
    rows = [(i, " ".join(ws)) for i, ws in enumerate(rows)]
    return rows + [(1000, "one two"), (1001, "One, two!"), (1002, None), (1003, ""), (1004, "..."), (1005, "one " * 40), (1006, "one " * 50)]


@pytest.mark.parametrize("small_bucket", [4, 2])
def test_near_duplicates_equal_loop(spark, small_bucket):
    rows = near_rows()
    got = near_dedup.near_duplicates(frame(spark, rows, "doc_id long, text string"), small_bucket=small_bucket).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_loop(rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("block", [1_000, 7])
def test_links_between_nodes_apart_from_their_leader(spark, block):
    """Chains of edits: ends are far from the middle, which leads the buckets, and linked to each other only."""
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = rows[rnd.randrange(max(0, i - 25), i)][1].split()
        for _ in range(rnd.randrange(1, 4)):
            words[rnd.randrange(len(words))] = f"n{i}x{rnd.randrange(1000)}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(frame(spark, rows, "doc_id long, text string"), block=block, small_bucket=2).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_loop(rows)
    assert len({r.class_id for r in got}) > 3


def test_bounds_are_never_below_the_similarity():
    rng = np.random.default_rng(22)
    made = []
    for n in (40, 40, 40, 400):
        ids = np.unique(rng.integers(0, 60 if n == 40 else 900, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        made.append((np.sort(ids), np.ones(len(ids), dtype=np.uint32)))
    made += [(ids, rng.integers(1, 4, len(ids)).astype(np.uint32)) for ids, _ in made]
    cells = [np.bincount((ids >> np.uint64(56)).astype(int), weights=x, minlength=256).astype(np.uint32) for ids, x in made]
    once = np.array([bool((x == 1).all()) for _, x in made])
    for (ids, x), sketch, single in zip(made, cells, once):
        bounds = near_dedup.similarity_bounds(sketch, single, np.array(cells), once)
        real = [near_dedup.probability_jaccard(ids, x, other, y) for other, y in made]
        assert (bounds >= np.array(real) - 1e-9).all()


def test_near_duplicates_odd_rows(spark):
    docs = odd(spark, texts(12, 10))
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.class_size for r in got if r.doc_id == 905} == {2}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_probability_jaccard_equals_its_definition():
    rng = np.random.default_rng(13)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(2))
        x, y = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
        plain = similarity(Counter(dict(zip(a.tolist(), x.tolist()))), Counter(dict(zip(b.tolist(), y.tolist()))))
        assert near_dedup.probability_jaccard(a, x, b, y) == pytest.approx(plain)


def test_registers_agree_as_often_as_the_weighted_sets_are_alike():
    rng = np.random.default_rng(14)
    ids = np.unique(rng.integers(0, 1 << 62, 300)).astype(np.uint64)
    a, b, x, y = ids[:220], ids[60:], rng.integers(1, 5, 220), rng.integers(1, 5, len(ids) - 60)
    agree = (near_dedup.prob_min_hash(a, x, 8192) == near_dedup.prob_min_hash(b, y, 8192)).mean()
    assert agree == pytest.approx(near_dedup.probability_jaccard(a, x, b, y), abs=0.025)


# ---- languages and quality


LETTERS = {"xx": "abcde", "yy": "fghij", "zz": "äöüßé"}


def words_of(lang, rnd, n):
    return " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randrange(2, 7))) for _ in range(n))


def test_languages_and_mixtures(spark):
    rnd = random.Random(15)
    rows = [(i, words_of(lang, rnd, 60), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    schema = "doc_id long, text string, lang string"
    model = language.fit_languages(frame(spark, rows, schema))
    mixed = words_of("xx", rnd, 120) + " " + words_of("zz", rnd, 40)
    new = [(i, words_of(lang, rnd, 30), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 10)]
    new += [(100, mixed, "m"), (101, None, "und"), (102, "", "und"), (103, "12 !!", "und"), (None, "abc", "xx"), (104, "abc " * 30_000, "xx")]
    got = {r.doc_id: r for r in language.identify_languages(frame(spark, new, schema), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in new if lang != "m")
    assert set(got[100].shares) == {"xx", "zz"} and got[100].shares["xx"] == pytest.approx(0.6, abs=0.06)  # by bytes: zz has two a letter
    assert all(0 <= r.score <= 1 for r in got.values()) and got[101].score == 0
    assert language.identify_languages(frame(spark, [], schema), model).count() == 0
    nothing = language.fit_languages(frame(spark, [(1, "abc", None)], schema))
    assert language.identify_languages(frame(spark, new, schema), nothing).where("lang_pred <> 'und'").count() == 0


def test_language_sets_equal_trying_all_sets(spark):
    """The set that is chosen step by step against the best of all sets by penalised likelihood."""
    rnd = random.Random(27)
    rows = [(i, words_of(lang, rnd, 60), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 20)]
    model = language.fit_languages(frame(spark, rows, "doc_id long, text string, lang string"))
    for parts in (["xx"], ["yy", "zz"], ["xx", "yy", "zz"], ["zz", "xx"]):
        text = " ".join(words_of(p, rnd, rnd.randrange(30, 60)) for p in parts)
        grams, counts = language.gram_counts(text, model.bits)
        counts = counts / len(language.GRAM_SIZES)
        log = model.log[grams]
        likelihood = np.exp(log - log.max(axis=1, keepdims=True))
        found = []
        for size in (1, 2, 3):
            for chosen in combinations(range(3), size):
                share, fit = language.mixture(likelihood[:, chosen], counts)
                found.append((fit - 2.0 * size * np.log(counts.sum()), chosen, share))
        _, chosen, share = max(found, key=lambda f: f[0])
        name, score, shares = model.languages_of(text, 2.0)
        assert {model.languages[j] for j in chosen} == set(shares) == set(parts)
        assert score == pytest.approx(share.max(), abs=1e-3) and name == model.languages[chosen[int(share.argmax())]]


def test_rows_without_id_do_not_swamp_the_fits(spark):
    rnd = random.Random(28)
    rows = [(i, words_of(lang, rnd, 40), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    rows += [(None, words_of("xx", rnd, 40), "xx") for _ in range(30)] + [(None, "abc abd", "xx")] * 60
    docs = frame(spark, [(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, `a.b` int, print int, share int")
    model = language.fit_languages(docs, per_language=50)
    assert model.languages == ["xx", "yy"]
    got = language.identify_languages(docs, model)
    assert got.count() == len(rows) and got.where("lang_pred = 'xx'").count() == 150
    labels = frame(spark, [(i, i % 2) for i in range(120)] + [(None, 1)] * 60, "doc_id long, quality int")
    twice = docs.unionByName(docs.where("doc_id < 40").withColumn("text", F.concat("text", F.lit(" more"))))
    first, second = (quality.fit_quality(d, labels) for d in (twice, twice.repartition(7)))
    assert np.array_equal(first.vectors, second.vectors) and len(first.labels) == 120


def test_more_languages_have_fewer_cells(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BITS", 14)
    rnd = random.Random(29)
    rows = [(i, words_of(lang, rnd, 80), f"{lang}{i % 30 if lang == 'yy' else ''}") for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    model = language.fit_languages(frame(spark, rows, "doc_id long, text string, lang string"))
    assert model.log.size <= 1 << 14 and len(model.languages) == 12
    assert model.languages_of(words_of("zz", rnd, 200), 2.0)[0] == "zz"


def test_mixture_finds_the_proportions():
    likelihood, counts = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]]), np.array([520.0, 200.0, 280.0])
    share, fit = language.mixture(likelihood, counts, rounds=500, close=1e-9)
    assert share == pytest.approx([0.7, 0.3], abs=1e-3) and fit < 0


def test_quality_votes(spark):
    rnd = random.Random(16)
    good = [words_of("xx", rnd, 50).capitalize() + "." for _ in range(60)]
    bad = [" ".join(f"{w.upper()}!!" for w in words_of("xx", rnd, 50).split()) for _ in range(60)]
    bad += ["spam " * rnd.randrange(30, 60) for _ in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 60)) for i in range(150) if i % 3] + [(0, None), (None, 1), (3, 0), (3, 1)]
    docs = frame(spark, rows)
    model = quality.fit_quality(docs, frame(spark, labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert all(got[i].predicted == int(i < 60) for i in range(150) if i % 3 == 0)
    strange = odd(spark, texts(17, 5))
    scored = quality.score_quality(strange, model).collect()
    assert len(scored) == strange.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.keep_quality(strange, model, threshold=-1.0).collect() == strange.collect()
    untaught = quality.fit_quality(docs, frame(spark, [], "doc_id long, quality int"))
    assert {r.score for r in quality.score_quality(docs, untaught).collect()} == {0.5}


def test_votes_equal_plain_neighbours(spark):
    rnd = random.Random(30)
    docs = frame(spark, [(i, words_of("xx" if i % 2 else "yy", rnd, 20), "s") for i in range(80)])
    labels = frame(spark, [(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, neighbours=7)
    x = model.project(quality.features(pa.array([r.text for r in docs.orderBy("doc_id").collect()])))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for i, v in enumerate(x):
        near = sorted(((float(u @ v), int(y)) for u, y in zip(model.vectors, model.labels)), reverse=True)[:7]
        weights = [max(s, 0.0) ** model.power for s, _ in near]
        assert got[i] == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights), abs=1e-3)


def test_quality_tells_junk_by_its_words(spark):
    rnd = random.Random(26)
    good, junk = (["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n)] for n in (900, 90))
    text = lambda words: " ".join(" ".join(rnd.choices(words, k=rnd.randrange(6, 12))).capitalize() + "." for _ in range(6))
    docs = frame(spark, [(i, text(good if i % 2 else junk), "s") for i in range(240)])
    labels = frame(spark, [(i, i % 2) for i in range(160)], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).where("doc_id >= 160").collect()
    assert all(r.predicted == r.doc_id % 2 for r in got) and len(got) == 80
