"""SimHash near duplicates by exact comparison of tiles of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.components import components
from trustloom.llm.periodic_runs import kept_text
from trustloom.llm.rows import column, packed, table
from trustloom.llm.words import WHITE_SPACE, small_batches, split_words, text_bytes
from trustloom.session import materialise

SEED = 42
AT_ONCE = 1 << 16  # shingles hashed at a time, 64 counters each
TILE = 2_048
#: A fingerprint is compared with the share of others whose population counts are near: about 1 in 65 with counts of 4
#: segments, 1 in 4,000 with 8, 1 in 2.5 million with 16. More fingerprints, more segments.
SEGMENTS = ((1 << 22, 4), (1 << 28, 8))
MOST_SEGMENTS = 16
HEAVY = 2_000


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words = split_words(batch.column("text"), WHITE_SPACE)
            # Every text as its words with one space between; then a shingle is a slice of it.
            joined = kept_text(words, np.ones(len(words.start), dtype=bool))
            data, first_byte = text_bytes(joined)
            data = data.tobytes().lower()  # A-Z only, as these are bytes
            n_words = np.diff(words.first)
            of = np.repeat(np.arange(len(n_words)), n_words)
            length = words.end - words.start
            behind = np.cumsum(length + 1)
            start = behind - length - 1
            start += (first_byte[:-1] - np.r_[start, 0][words.first[:-1]])[of]
            end = start + length
            place = np.arange(len(of)) - words.first[of]
            begins = np.flatnonzero((place == 0) | (place + size <= n_words[of]))
            last = np.minimum(begins + size, words.first[of[begins] + 1]) - 1
            start, end, of = start[begins], end[last], of[begins]
            ones = np.zeros((len(n_words), 64), dtype=np.int64)
            for at in range(0, len(start), AT_ONCE):
                slices = zip(start[at : at + AT_ONCE].tolist(), end[at : at + AT_ONCE].tolist())
                hashes = np.array([xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in slices], dtype="<u8")
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                rows, begin = np.unique(of[at : at + AT_ONCE], return_index=True)
                ones[rows] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
            total = np.bincount(of, minlength=len(n_words))
            packed_bits = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
            yield pa.record_batch(
                [batch.column("id"), pa.array(packed_bits.view("<i8").ravel())], names=["id", "print"])

    return run, "id bigint, print bigint"


def _steps(segments: int, radius: int) -> list[int]:
    """What may be added to the packed population counts of a fingerprint to get those of one at most ``radius`` bits away:
    the pairs once, so only the steps upward and none."""
    width = 64 // segments
    found = {0}
    for _ in range(radius):
        found |= {x + sign * (1 << (width * k)) for x, k, sign in product(found, range(segments), (-1, 1))}
    return sorted(x for x in found if x >= 0)


def _counts(value: Column, segments: int) -> Column:
    """The population counts of the segments of a fingerprint, each in the place of its segment."""
    width = 64 // segments
    mask = (1 << width) - 1
    key = F.lit(0).cast("long")
    for k in range(segments):
        part = F.shiftrightunsigned(value, width * k).bitwiseAND(F.lit(mask).cast("long"))
        key = key + F.shiftleft(F.bit_count(part).cast("long"), width * k)
    return key


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the two ends of each link the same label, the smallest one that can be reached."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while not np.array_equal(onward := labels[labels], labels):
            labels[:] = onward


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of fingerprints, as many as it takes to join those at most ``radius`` bits apart."""
    both = np.concatenate([a, b])
    labels = np.arange(len(both))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        _join_labels(labels, i + at, j + len(a))
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return both[linked], both[labels[linked]]


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: tuple[list, list] = [], []
            left, right = (
                (c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in map(batch.column, ("a", "b")))
            for k in range(batch.num_rows):
                for end, found in zip(ends, tile_links(
                        left[0][left[1][k] : left[1][k + 1]], right[0][right[1][k] : right[1][k + 1]], radius)):
                    end.append(found)
            a, b = (np.concatenate([*e, np.zeros(0, dtype=np.uint64)]).view(np.int64) for e in ends)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run, "a bigint, b bigint"


def near_links(prints: DataFrame, n: int, *, radius: int = 2, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints`` (print), ``n`` of them, that join all pairs at most
    ``radius`` bits apart.

    Fingerprints with the same population count in each segment form tiles of about ``tile``. Flipping a bit changes one
    count by one. So tiles meet only if their counts differ by ``radius`` in all at most; every such pair of tiles is one
    row, compared in full.
    """
    segments = segments or next((s for most, s in SEGMENTS if n <= most), MOST_SEGMENTS)
    keyed = prints.select("print", _counts(F.col("print"), segments).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    placed = keyed.join(sizes, "key").withColumn("chunk", F.expr("pmod(xxhash64(print), chunks)").cast("int"))
    tiles = materialise(
        placed.groupBy("key", "chunk").agg(F.first("chunks").alias("chunks"), F.collect_list("print").alias("prints")),
        "tiles")
    steps = F.explode(F.array(*(F.lit(s).cast("long") for s in _steps(segments, radius))))
    near = tiles.select("key", "chunk", steps.alias("step")).select(
        F.col("key").alias("a_key"), F.col("chunk").alias("a_chunk"), (F.col("key") + F.col("step")).alias("key"), "step")
    # A tile meets the later chunks of its own key only, and itself.
    others = F.explode(F.sequence(F.when(F.col("step") == 0, F.col("a_chunk")).otherwise(0), F.col("chunks") - 1))
    near = near.join(tiles.where(F.col("chunk") == 0).select("key", "chunks"), "key").select(
        "a_key", "a_chunk", F.col("key").alias("b_key"), others.alias("b_chunk"))
    for side in "ab":
        near = near.join(
            tiles.select(F.col("key").alias(f"{side}_key"), F.col("chunk").alias(f"{side}_chunk"), F.col("prints").alias(side)),
            [f"{side}_key", f"{side}_chunk"])
    return near.select("a", "b").mapInArrow(*_compared(radius))


def simhash_classes(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2, tile: int = TILE,
    segments: int | None = None, heavy: int = HEAVY,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``print`` (the fingerprint, a long) and ``class_id``, the smallest id among the
    documents that can be reached over links; other columns play no part.

    Words stand between ASCII white space, A-Z count as a-z. A fingerprint's bit is set if it is set in more than half of
    the hashes of all runs of ``size`` words, repeats included; a shorter text is one run, and one without words (null,
    empty, white space) has fingerprint 0 and is linked like any other. Documents whose fingerprints differ in at most
    ``radius`` bits are linked. Nulls never name a class: it has a null ``class_id`` only if none of its documents has an
    id. Repeated rows come back as often as they came.

    Equal fingerprints fall together first, so a group of copies is one entry of a tile however large it is. Comparing
    tiles gives no more links than it takes to join what they hold. Fingerprints of more than one in ``heavy`` documents,
    which are fewer than that, are looked up in a broadcast table; the join of all others has no key with more rows.
    """
    source = packed(docs).select(
        column(id, "row").cast("long").alias("id"), F.coalesce(column(text, "row"), F.lit("")).alias("text"))
    signed = materialise(source.mapInArrow(*_fingerprints(size)), "simhash")
    groups = materialise(signed.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n")), "prints")
    seen = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    links = materialise(near_links(groups, seen["groups"], radius=radius, tile=tile, segments=segments), "simhash-links")
    labelled = groups.join(components(links).withColumnRenamed("node", "print"), "print", "left").withColumn(
        "label", F.coalesce("label", "print"))
    least = labelled.groupBy("label").agg(F.min("id").alias("class_id"))
    classes = materialise(labelled.join(least, "label").select("print", "n", "class_id"), "simhash-classes")
    many = F.col("n") * heavy > seen["rows"]
    common = F.broadcast(classes.where(many).select("print", "class_id"))
    found = signed.join(common, "print").unionByName(
        signed.join(common, "print", "left_anti").join(classes.where(~many).select("print", "class_id"), "print"))
    return found.select(F.col("id").alias(id), "print", "class_id")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("class_id").alias("component_id"))


QUERIES = {"op13_simhash": op13_simhash}
ORACLES: dict[str, str] = {}
