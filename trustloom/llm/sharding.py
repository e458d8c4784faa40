"""A uniform shuffle into shards of exact sizes, from a hypergeometric communication matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.rows import column, let, packed, table, unpacked

# Numbers in the broadcast matrix: 32 MB.
MATRIX_CELLS = 4_000_000
ROW_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def _uniform(*key: Column | int) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in key)), 11)
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many marked ones are among ``drawn`` of ``total``, of which ``marked`` are marked, by inversion at ``u``.

    The support is walked from ten standard deviations and 20 below the mode to as many above; what lies outside weighs
    less than the rounding of a double.
    """
    real = lambda c: c.cast("double")
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - total)
    high = F.least(drawn, marked)
    mode = F.floor((real(drawn) + 1) * (real(marked) + 1) / (real(total) + 2))
    share = real(marked) / real(total)
    spread = F.sqrt(real(drawn) * share * (1 - share) * (real(total) - real(drawn)) / F.greatest(real(total) - 1, F.lit(1.0)))
    reach = F.ceil(spread * 10) + 20
    bounds = F.struct(F.greatest(low, mode - reach).alias("a"), F.least(high, mode + reach).alias("b"))

    def step(w: Column, k: Column) -> Column:
        return w * real(marked - k + 1) * real(drawn - k + 1) / (real(k) * real(total - marked - drawn + k))

    def draw(at: Column) -> Column:
        ks = F.sequence(at["a"] + 1, at["b"])
        weight = F.aggregate(
            ks, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")),
            lambda s, k: let(step(s["w"], k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))),
            lambda s: s["sum"],
        )
        return let(weight * u, lambda goal: F.aggregate(
            ks, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), at["a"].alias("x")),
            lambda s, k: F.when(s["sum"] >= goal, s).otherwise(
                let(step(s["w"], k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), k.alias("x")))),
            lambda s: s["x"],
        ))

    return let(bounds, lambda at: F.when(at["a"] >= at["b"], at["a"]).otherwise(draw(at)))


def _deal(parts: Column, room: Column, seed: int) -> Column:
    """Counts for each of ``parts`` (id, n), one after the other: how many of its n go to each shard, given the ``room``
    left there. A multivariate hypergeometric draw is one draw per shard from what the shards before it left."""
    counts_type = "array<bigint>"

    def one(left: Column, part: Column) -> Column:
        start = F.struct(
            F.aggregate(left, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
            part["n"].alias("n"), F.array().cast(counts_type).alias("counts"),
        )

        def shard(s: Column, place: Column) -> Column:
            x = hypergeometric(_uniform(seed, part["id"], place["i"]), s["total"], place["room"], s["n"])
            return let(x, lambda x: F.struct(
                (s["total"] - place["room"]).alias("total"), (s["n"] - x).alias("n"),
                F.concat(s["counts"], F.array(x)).alias("counts")))

        places = F.transform(left, lambda x, i: F.struct(x.alias("room"), i.alias("i")))
        return F.aggregate(places, start, shard, lambda s: s["counts"])

    start = F.struct(room.alias("left"), F.array().cast(f"array<struct<id:bigint,counts:{counts_type}>>").alias("out"))
    return F.aggregate(parts, start, lambda s, part: let(one(s["left"], part), lambda counts: F.struct(
        F.zip_with(s["left"], counts, lambda a, b: a - b).alias("left"),
        F.concat(s["out"], F.array(F.struct(part["id"].alias("id"), counts.alias("counts")))).alias("out"),
    )), lambda s: s["out"])


def communication_matrix(parts: DataFrame, rows: int, partitions: int, shards: int, seed: int) -> DataFrame:
    """For each partition (p, n) an array ``upto``: its first upto[0] rows go to shard 0, those below upto[1] to 1, ...

    Drawn in two levels, groups of partitions first and then the members of each group side by side, so that no task
    handles more than about the square root of the partitions.
    """
    groups = max(1, math.isqrt(partitions))
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.lit(rows // shards).cast("long") + F.when(s < rows % shards, 1).otherwise(0),
    )
    parts = parts.select(F.col("p").cast("long").alias("id"), F.col("n").cast("long").alias("n"))
    members = (
        parts.groupBy(F.pmod("id", F.lit(groups)).alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"), F.sum("n").alias("n"))
    )
    top = members.agg(F.sort_array(F.collect_list(F.struct(F.col("g").alias("id"), F.col("n")))).alias("groups"))
    rooms = top.select(F.explode(_deal(F.col("groups"), sizes, seed)).alias("x")).select(
        F.col("x.id").alias("g"), F.col("x.counts").alias("room"))
    dealt = members.join(rooms, "g").select(F.explode(_deal(F.col("members"), F.col("room"), seed + 1)).alias("x"))
    upto = F.transform("x.counts", lambda _, i: F.aggregate(
        F.slice("x.counts", 1, i + 1), F.lit(0).cast("long"), lambda s, c: s + c))
    return dealt.select(F.col("x.id").alias("p"), upto.alias("upto"))


def shard_rows(
    docs: DataFrame, *, shards: int, order_by: tuple[str, ...], seed: int = 7, rows_per_block: int = 100_000,
    matrix_cells: int = MATRIX_CELLS,
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (these replace columns of those names): a uniform shuffle of all rows into
    shards whose counts differ by one row at most, slots running from 0 without gaps.

    How many rows of each input partition go to each shard is drawn first. Every partition is then put in random order
    where it lies, its rows go to the shards by those counts, and every shard is put in random order again. Whole rows
    cross the network once. A shard is sorted in blocks of about ``rows_per_block`` rows, so one shard is many tasks.

    The random order is a function of ``order_by`` and ``seed``: the same input gives the same shards, also where a
    lost task runs again. ``docs`` must come in the same partitions whenever it is read, as a table scan does; write
    the result of a shuffle first. Nulls are ordinary values. Equal rows are interchangeable and go where the draw
    sends them. Texts of any length are moved, never read. No rows, no shards.
    """
    limit = max(1, matrix_cells // shards)
    ids = F.monotonically_increasing_id()
    count = lambda d: d.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    parts = count(docs)
    rows, last = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("p"), F.lit(0))).first()
    if last >= limit:
        docs = docs.coalesce(limit)
        parts = count(docs)
    matrix = communication_matrix(parts, rows, min(last + 1, limit), shards, seed)
    blocks = max(1, math.ceil(rows / shards / rows_per_block))

    def dealt(d: DataFrame) -> DataFrame:
        placed = d.withColumn("id", ids).select(
            "*", F.shiftright("id", ROW_BITS).alias("p"), F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("i"))
        placed = placed.join(F.broadcast(matrix), "p").withColumn("key", F.xxhash64(F.lit(seed + 2), "id"))
        shard = F.size(F.filter("upto", lambda x: x <= F.col("i")))
        return placed.select(
            *d.columns, "id", "key", shard.alias("shard"), F.pmod("key", F.lit(blocks)).cast("int").alias("block"))

    local = packed(docs).withColumn("__order", F.xxhash64(F.lit(seed + 3), *(column(c, "row") for c in order_by)))
    local = local.sortWithinPartitions("__order", *(column(c, "row") for c in order_by)).drop("__order")
    out = dealt(local)
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "id")).cast("long") - 1
    if blocks > 1:
        # Which block a place goes to depends on the place alone, so this count reads no column.
        sizes = dealt(docs.select()).groupBy("shard", "block").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
        offsets = sizes.select("shard", "block", before.alias("before"))
        out = out.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "block"])
        slot = F.col("rank") + F.col("before")
    else:
        out, slot = out.withColumn("rank", rank), F.col("rank")
    return out.select(*unpacked(out, docs.columns, but=("shard", "slot")), "shard", slot.alias("slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return shard_rows(docs, shards=24, order_by=("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
