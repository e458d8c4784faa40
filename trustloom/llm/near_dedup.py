"""Near-duplicate documents by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.components import components
from trustloom.llm.rows import column, packed, table
from trustloom.llm.words import LOWER_WORDS, mix, small_batches, split_words, window_prints
from trustloom.llm.words import _WORD_POWERS as WORD_POWERS
from trustloom.session import materialise

BANDS, ROWS = 32, 6  # a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**6)**32 = 0.99994
SMALL_BUCKET = 4
CELL_BITS, BLOCK = 10, 1_000  # a sketch has 4 KB, two blocks of them 8 MB
ROUNDING = 1e-9  # a similarity of exactly the threshold may come out a little lower
DOCS_AT_ONCE = 512  # of 1.5 KB of registers each
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words with their counts, sorted. A shorter text is one shingle, no words none."""
    if len(prints) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.unique(window_prints(prints, min(size, len(prints))), return_counts=True)


def prob_min_hash(ids: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The elements that arrive first in each register."""
    return prob_min_hashes(np.zeros(len(ids), dtype=np.int64), ids, weights, 1, registers)[0]


def prob_min_hashes(doc: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """For each of ``n`` documents the elements that arrive first in each register; ``doc`` tells whose an element is.

    Each element is a Poisson process whose rate is its weight; every arrival falls into a random register. An element
    stops as soon as its next arrival comes later than its document's last register was filled, as it can change nothing
    any more. Two weighted sets agree in a register with a probability equal to their probability Jaccard similarity. All
    documents take their next arrivals together.
    """
    first, winner = np.full(n * registers, np.inf), np.zeros(n * registers, dtype=np.uint64)
    time, rate, state = np.zeros(len(ids)), weights.astype(float), ids
    while len(ids):
        state = state + _STEP
        draw = mix(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        place = doc * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        winner[place[won]] = ids[won]
        going = time < first.reshape(n, registers).max(axis=1)[doc]
        doc, ids, time, rate, state = doc[going], ids[going], time[going], rate[going], state[going]
    return winner.reshape(n, registers)


def batch_shingles(prints: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count): the distinct shingles of each document, sorted; ``first`` tells where each begins in
    ``prints`` (one more entry than documents)."""
    n = np.diff(first)
    count = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    ends = np.cumsum(count)
    places = np.arange(count.sum()) + np.repeat(first[:-1] - (ends - count), count)
    found = [window_prints(prints, size)[places]] if len(places) else []
    docs = [doc]
    short = np.flatnonzero((n > 0) & (n < size))
    for length in np.unique(n[short]):
        of = short[n[short] == length]
        docs.append(of)
        found.append(window_prints(prints, int(length))[first[of]])
    doc, ids = np.concatenate(docs), np.concatenate([*found, np.zeros(0, dtype=np.uint64)])
    order = np.lexsort((ids, doc))
    doc, ids = doc[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], ids[starts], np.diff(np.r_[starts, len(ids)])


def text_prints(prints: np.ndarray, first: np.ndarray, which: int) -> np.ndarray:
    """A fingerprint for all words of each document together; 0 without words."""
    up, down = WORD_POWERS[which](len(prints) + 1)
    sums = np.zeros(len(prints) + 1, dtype=np.uint64)
    np.cumsum(prints * up[:-1], out=sums[1:])
    whole = mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]])
    return np.where(np.diff(first) > 0, whole, np.uint64(0))


def probability_jaccard(ids_a: np.ndarray, x: np.ndarray, ids_b: np.ndarray, y: np.ndarray) -> float:
    """Sum over the shared elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). Both id arrays are sorted.

    x_j / x_i is the larger of the two just where x_j / y_j >= x_i / y_i, so one sort by that ratio gives all sums.
    """
    shared, at_a, at_b = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    xs, ys = x[at_a].astype(float), y[at_b].astype(float)
    only_a, only_b = float(x.sum()) - xs.sum(), float(y.sum()) - ys.sum()
    ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    ratio = ratio[order]
    x_above = np.r_[np.cumsum(xs[order][::-1])[::-1], 0.0] + only_a
    y_below = np.r_[0.0, np.cumsum(ys[order])] + only_b
    cut = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(1.0 / (x_above[cut] / xs[order] + y_below[cut] / ys[order])))


def _signatures(size: int, bands: int, rows: int):
    arrow = pa.schema([
        ("id", pa.int64()), ("print", pa.int64()), ("n_words", pa.int32()), ("node", pa.int64()), ("check", pa.int64()),
        ("bands", pa.list_(pa.int64()))])
    base = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _STEP).reshape(bands, rows) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words = split_words(batch.column("text"), LOWER_WORDS)
            n = np.diff(words.first)
            node, check = (text_prints(words.print, words.first, w) for w in (0, 1))
            keys = np.zeros((len(n), bands), dtype=np.uint64)
            for at in range(0, len(n), DOCS_AT_ONCE):
                begin = words.first[at : at + DOCS_AT_ONCE + 1]
                found = batch_shingles(words.print[begin[0] : begin[-1]], begin - begin[0], size)
                winner = prob_min_hashes(*found, len(begin) - 1, bands * rows)
                keys[at : at + len(begin) - 1] = mix(
                    (winner.reshape(-1, bands, rows) * base).sum(axis=2, dtype=np.uint64))
            offsets = np.r_[0, np.cumsum(np.where(n > 0, bands, 0))].astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel().view(np.int64)))
            yield pa.record_batch([
                batch.column("id"), batch.column("print"), pa.array(n.astype(np.int32)),
                pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), flat], schema=arrow)

    return run, "id bigint, print bigint, n_words int, node bigint, check bigint, bands array<bigint>"


def _packed_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words = split_words(batch.column("text"), LOWER_WORDS)
            ids, counts = [], []
            for i in range(batch.num_rows):
                a, x = shingles(words.print[words.first[i] : words.first[i + 1]], size)
                ids.append(a.tobytes())
                # Mostly every shingle occurs once; then the counts are left out.
                counts.append(b"" if (x == 1).all() else x.astype(np.uint32).tobytes())
            yield pa.record_batch(
                [batch.column("node"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                names=["node", "ids", "counts"])

    return run, "node bigint, ids binary, counts binary"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def unpack(ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, dtype=np.uint64)
        return ids, np.frombuffer(counts, dtype=np.uint32) if counts else np.ones(len(ids), dtype=np.uint32)

    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("ids_a", "counts_a", "ids_b", "counts_b"))
        similarity = [probability_jaccard(*unpack(ia, ca), *unpack(ib, cb)) for ia, ca, ib, cb in zip(*cols)]
        yield pa.record_batch(
            [batch.column("a"), batch.column("b"), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])


def _buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (key, band, node) of the buckets that hold several nodes, with their number ``n`` and the ``leader``: the
    node that meets most others over all its buckets. In a group of copies that is the one they were made from, or one
    close to it, so that most of the group is linked to it at once. Written."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = materialise(rows.join(sizes, "key"), "shared")
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    # One number orders by what a node meets and then by its fingerprint, so that finding the largest is a hash aggregate.
    rank = (F.least("met", F.lit((1 << 31) - 1)) * (1 << 32) + F.shiftrightunsigned("node", 32)).alias("rank")
    ranked = shared.join(met, "node").select(*shared.columns, rank)
    top = ranked.groupBy("key").agg(F.max("rank").alias("rank"))
    leaders = ranked.join(top, ["key", "rank"]).groupBy("key").agg(F.min("node").alias("leader"))
    return materialise(shared.join(leaders, "key"), "buckets")


def _pairs(buckets: DataFrame, small: int) -> DataFrame:
    """All pairs of a small bucket, the leader with every other node in a larger one."""
    few = buckets.where(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    few = few.select(F.explode(F.flatten(F.transform("nodes", lambda a, i: F.transform(
        F.slice("nodes", i + 2, F.lit(small)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    many = buckets.where((F.col("n") > small) & (F.col("node") != F.col("leader")))
    many = many.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    return few.select("p.a", "p.b").unionByName(many).distinct()


def _labelled(rows: DataFrame, labels: DataFrame, *nodes: str) -> DataFrame:
    """``rows`` with the component of each of the columns ``nodes``; a node without links is its own."""
    for name in nodes:
        of = labels.select(F.col("node").alias(name), F.col("label").alias("label"))
        rows = rows.join(of, name, "left").withColumn(f"{name}_label", F.coalesce("label", name)).drop("label")
    return rows


def _mixed(buckets: DataFrame, labels: DataFrame, small: int) -> DataFrame:
    """The nodes (key, band, node, label, apart, n, n_apart) of the large buckets that hold nodes ``apart`` from their leader's
    component. Written."""
    large = _labelled(buckets.where(F.col("n") > small), labels, "node", "leader").select(
        "key", "band", "node", F.col("node_label").alias("label"), "n", (F.col("node_label") != F.col("leader_label")).alias("apart"))
    sums = large.groupBy("key").agg(F.count_if("apart").alias("n_apart")).where(F.col("n_apart") > 0)
    return materialise(large.join(sums, "key"), "mixed")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much weight a node has in each cell of its shingles, and whether all of its shingles occur once."""
    for batch in batches:
        ids, counts = batch.column("ids").to_pylist(), batch.column("counts").to_pylist()
        sketch = [
            np.bincount(
                (np.frombuffer(i, dtype=np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64),
                weights=np.frombuffer(c, dtype=np.uint32) if c else None, minlength=1 << CELL_BITS,
            ).astype(np.uint32).tobytes() for i, c in zip(ids, counts)]
        yield pa.record_batch(
            [batch.column("node"), pa.array(sketch, pa.binary()), pa.array([not c for c in counts])],
            names=["node", "sketch", "once"])


def similarity_bounds(x: np.ndarray, x_once: bool, y: np.ndarray, y_once: np.ndarray) -> np.ndarray:
    """An upper bound of the probability Jaccard similarity of a sketch to each row of ``y``.

    Each term of the sum is at most the smaller one of the element's two shares of weight, and these add up to no more
    than the smaller shares of the cells do. Where all shingles occur once, the similarity is that of plain sets.
    """
    n_x, n_y = x.sum(dtype=np.int64), y.sum(axis=1, dtype=np.int64)
    both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    bounds = both / (n_x + n_y - both)
    rest = np.flatnonzero(~(x_once & y_once))
    if len(rest):
        bounds[rest] = np.minimum(x / n_x, y[rest] / n_y[rest, None]).sum(axis=1)
    return bounds


def _screened(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        node, label, apart, once, probe = (
            rows.column(c).to_numpy() for c in ("node", "label", "apart", "once", "probe"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint32).reshape(len(node), -1)
        bands = np.array(rows.column("bands").to_pylist())
        band = rows.column("band")[0].as_py()
        others = np.flatnonzero(~probe)
        y, y_once = sketch[others], once[others]
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i in np.flatnonzero(probe):
            # Two nodes that are both apart meet twice.
            new = (label[others] != label[i]) & (~apart[others] | (node[others] > node[i]))
            near = others[new][similarity_bounds(sketch[i], once[i], y[new], y_once[new]) >= threshold - ROUNDING]
            # A pair that shares several bands is taken in the first of them.
            near = near[(bands[near] == bands[i]).argmax(axis=1) == band]
            a.append(np.minimum(node[near], node[i]))
            b.append(np.maximum(node[near], node[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _screen(mixed: DataFrame, nodes: DataFrame, shingled: DataFrame, threshold: float, block: int) -> DataFrame:
    """The pairs (a, b) of nodes of one bucket, from different components, whose sketches allow a link.

    Within a bucket, blocks of nodes that are apart meet blocks of all its nodes, one pair of blocks at a time. Only
    pairs that may be links leave a task."""
    sketches = shingled.select("node", "ids", "counts").mapInArrow(_sketches, "node bigint, sketch binary, once boolean")
    blocks, probes = (F.ceil(F.col(c) / block).cast("int") for c in ("n", "n_apart"))
    i, j = F.pmod(F.hash("node"), probes), F.pmod(F.hash("node"), blocks)
    as_other = F.transform(F.sequence(F.lit(0), probes - 1), lambda k: F.struct(
        k.alias("i"), j.alias("j"), F.lit(False).alias("probe")))
    as_probe = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
        i.alias("i"), k.alias("j"), F.lit(True).alias("probe")))
    roles = F.when(F.col("apart"), F.concat(as_other, as_probe)).otherwise(as_other)
    placed = mixed.join(sketches, "node").join(nodes.select("node", "bands"), "node").select(
        "key", "band", "node", "label", "apart", "once", "sketch", "bands", F.inline(roles))
    return placed.groupBy("key", "i", "j").applyInArrow(_screened(threshold), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8,
    bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET, block: int = BLOCK,
) -> DataFrame:
    """Per document: ``id``, ``print`` (xxhash64 of the text, null as empty), ``n_words``, ``class_id`` (the smallest id
    of its class) and ``class_size``.

    Words are runs of letters and digits, A-Z as a-z. A document's shingles are its runs of ``size`` words, weighted by
    how often they occur; a shorter one is one shingle. Two documents are linked if the probability Jaccard similarity
    of their shingles is at least ``threshold``; classes are the connected components.

    1. Documents with equal words fall together first: one node each, however many copies there are.
    2. ProbMinHash signatures in ``bands`` bands of ``rows`` registers; nodes that share a band share a bucket.
    3. Every pair of a bucket of up to ``small_bucket`` nodes, and the leader of a larger one with all others, is
       verified on the shingles themselves. That links most of a group of copies at once.
    4. What is left are pairs of nodes of one large bucket from different components. All of them are screened by an upper
       bound of their similarity, from counts of their shingles in 2**CELL_BITS cells; those that may be links are
       verified. So no pair that shares a band goes unjudged, except between nodes already in one component, where a link
       changes nothing. The screening compares blocks of at most about ``block`` nodes: only arithmetic, and that only for
       nodes apart from their bucket's leader, grows with more than the size of a bucket.
    5. Components of all links; class ids go back to all copies.

    Signatures, nodes and links are written tables; nothing of them passes the driver but counts. Documents without
    words (null, empty, no letter or digit) are classes of their own. Rows repeated whole are copies of each other; each
    row comes back. A null id never names a class, unless the class has no other. Should two different word sequences
    ever share their 64-bit node (a second fingerprint tells), the job fails rather than merge them.
    """
    source = packed(docs).select(
        column(id, "row").cast("long").alias("id"), F.coalesce(column(text, "row"), F.lit("")).alias("text"))
    source = source.withColumn("print", F.xxhash64("text"))
    signed = materialise(source.mapInArrow(*_signatures(size, bands, rows)), "signatures")

    worded = signed.where(F.col("n_words") > 0)
    nodes = worded.groupBy("node").agg(
        F.min(F.struct("id", "print")).alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi"),
        F.first("bands").alias("bands"))
    clash = F.raise_error(F.lit("two texts share a fingerprint"))
    nodes = nodes.withColumn("node", F.when(F.col("lo") == F.col("hi"), F.col("node")).otherwise(clash))
    nodes = materialise(nodes.select("node", "rep", "bands"), "nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = _buckets(keyed.select(F.xxhash64("band", "value").alias("key"), "band", "node"))
    pairs = materialise(_pairs(buckets, small_bucket), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = ends.join(nodes, "node").select("node", "rep.id", "rep.print")
    same = source["id"].eqNullSafe(wanted["id"]) & (source["print"] == wanted["print"])
    texts = source.join(wanted, same).select("node", "text")
    shingled = materialise(
        texts.mapInArrow(*_packed_shingles(size)).dropDuplicates(["node"]), "shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        one = shingled.select(F.col("node").alias("a"), F.col("ids").alias("ids_a"), F.col("counts").alias("counts_a"))
        two = shingled.select(F.col("node").alias("b"), F.col("ids").alias("ids_b"), F.col("counts").alias("counts_b"))
        both = pairs.join(one, "a").join(two, "b")
        near = both.mapInArrow(_verified, "a bigint, b bigint, similarity double")
        return materialise(near.where(F.col("similarity") >= threshold - ROUNDING), "links")

    links = verify(pairs)
    labels = components(links)
    mixed = _mixed(buckets, labels, small_bucket)
    more = verify(materialise(_screen(mixed, nodes, shingled, threshold, block), "pairs"))
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    member = signed.join(labels, "node", "left")
    member = member.withColumn("label", F.when(F.col("n_words") > 0, F.coalesce("label", "node")))
    classes = member.where(F.col("n_words") > 0).groupBy("label").agg(
        F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    alone = F.col("n_words") == 0
    return member.join(classes, "label", "left").select(
        F.col("id").alias(id), "print", "n_words",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", F.col("n_words").cast("long").alias("n_words"))


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
