"""Trust that spreads along citations."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.functions.scalar import damped
from trustloom.session import materialise

DEFAULT_TRUST = 0.5


def nodes_of(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Every source that cites, is cited, or is declared without edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if declared is not None:
        ends = ends.unionByName(declared.select("node"))
    return ends.distinct()


def citers(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Reverse adjacency in numbers: (node, n_citations, n_citers) with parallel edges counted in the first."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("times"))
    # Both ends of a pair in one pass: the citing one with nothing received.
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    ends = F.array(
        F.struct(F.col("src").alias("node"), none.alias("times"), none.alias("one")),
        F.struct(F.col("dst").alias("node"), F.col("times").alias("times"), one.alias("one")),
    )
    received = pairs.select(F.inline(ends))
    if declared is not None:
        received = received.unionByName(declared.select("node", none.alias("times"), none.alias("one")))
    return received.groupBy("node").agg(F.sum("times").alias("n_citations"), F.sum("one").alias("n_citers"))


def source_trust(
    edges: DataFrame,
    direct: DataFrame,
    *,
    declared: DataFrame | None = None,
    iterations: int = 10,
    damping: float = 0.85,
    checkpoint_every: int = 5,
    split_above: int = 1_000_000,
) -> DataFrame:
    """(node, trust) after ``iterations`` synchronous rounds.

    ``edges``: (src, dst), parallel edges kept. ``direct``: (node, direct); 0.5 where missing, and sources outside the
    graph are not part of the result. A round sets trust = (1 - damping) * direct + damping * mean trust of the citers
    (0.5 without any).

    Parallel edges become one weighted edge, written once. Edges are laid out once by (src, part) and kept; a source
    with more than ``split_above`` outgoing edges is spread over several parts, and only its trust is repeated per part.
    A round then moves node-sized data only, and a much-cited node arrives as one partial sum per task.
    """
    weighted = materialise(
        edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("times")), "weighted-edges"
    )
    # A given number of partitions makes adaptive execution keep both layouts, so that no round shuffles or sorts them
    # again.
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (
        weighted.groupBy(F.col("src").alias("node"))
        .agg(F.count("*").alias("_out"))
        .select("node", F.ceil(F.col("_out") / F.lit(split_above)).cast("int").alias("parts"))
    )
    nodes = (
        nodes_of(weighted, declared)
        .join(direct.select("node", "direct"), "node", "left")
        .join(parts, "node", "left")
        .select(
            "node",
            F.coalesce(F.col("direct").cast("double"), F.lit(DEFAULT_TRUST)).alias("direct"),
            F.coalesce(F.col("parts"), F.lit(0)).alias("parts"),
        )
        .repartition(width, "node")
        .sortWithinPartitions("node")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    laid_out = (
        weighted.join(parts.withColumnRenamed("node", "src"), "src")
        .select("src", "dst", "times", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"))
        .repartition(width, "src", "part")
        .sortWithinPartitions("src", "part")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )

    trust = nodes.withColumn("trust", F.col("direct"))
    for i in range(iterations):
        given = trust.where(F.col("parts") > 0).select(
            F.col("node").alias("src"), "trust", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        )
        received = (
            laid_out.join(given, ["src", "part"])
            .groupBy(F.col("dst").alias("node"))
            .agg((F.sum(F.col("times") * F.col("trust")) / F.sum("times")).alias("network"))
        )
        network = F.coalesce(F.col("network"), F.lit(DEFAULT_TRUST))
        trust = nodes.join(received, "node", "left").select(
            "node", "direct", "parts", damped(F.col("direct"), network, damping).alias("trust")
        )
        if (i + 1) % checkpoint_every == 0 and i + 1 < iterations:
            trust = materialise(trust, "trust-round")
    result = materialise(trust.select("node", "trust"), "trust")
    laid_out.unpersist()
    nodes.unpersist()
    return result
