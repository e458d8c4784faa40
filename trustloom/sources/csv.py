"""CSV scans. Columns are found by header name, file by file; what happens to bad rows is part of each scan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.functions.constants import MISSING_TEXTS, SOURCE_EVENT_COLUMNS, TIMESTAMP_FORMAT
from trustloom.session import materialise


# Places within a partition of a scan take so many bits of a row's number, its file the others.
PLACE_BITS = 33


@dataclass
class _Files:
    """The files of a folder that have one header, and where all files of the folder stand in the order of their names."""

    spark: SparkSession
    paths: list[str]
    order: DataFrame

    def records(self, mode: str, corrupt: str | None = None) -> DataFrame:
        """All columns as strings, with ``_file`` and ``_place``. Quoted fields may hold line breaks, which makes one file
        one task: many files, or parquet, for large data. Column pruning is off so that a short or long record is seen
        whatever is selected. ``corrupt`` names a column for records that do not fit the header."""
        reader = self.spark.read.option("columnPruning", False).option("enforceSchema", False)
        options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": mode}
        rows = reader.csv(self.paths, **options)
        if corrupt:
            schema = ", ".join(f"`{c}` string" for c in [*rows.columns, corrupt])
            rows = reader.schema(schema).csv(self.paths, columnNameOfCorruptRecord=corrupt, **options)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        return rows.select("*", F.col("_metadata.file_path").alias("_file"), place.alias("_place"))

    def in_order(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``seq``, which grows with the name of the file and the place in it."""
        numbered = rows.join(self.order, "_file")
        return numbered.withColumn("seq", F.col("_rank") * (1 << PLACE_BITS) + F.col("_place")).drop("_file", "_place", "_rank")


def _files(spark: SparkSession, path: str) -> list[_Files]:
    """The files at ``path`` by header: their columns are taken by name whatever their order. The headers are the first
    lines of all files, found by a scan of the files' first blocks; folders of a single header are read by their path, and
    only of others does the driver list the files."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("at"),
        F.struct(F.monotonically_increasing_id().alias("place"), F.col("value").alias("header")).alias("line"))
    firsts = materialise(
        lines.where("at = 0").groupBy("_file").agg(F.min("line").alias("line")).select("_file", "line.header"), "headers")
    order = firsts.select("_file", F.row_number().over(Window.orderBy("_file")).cast("bigint").alias("_rank"))
    headers = firsts.groupBy("header").agg(F.count("*").alias("n")).orderBy("header").collect()
    if len(headers) < 2:
        return [_Files(spark, [path], order)]
    by_header = defaultdict(list)
    for r in firsts.orderBy("_file").collect():
        by_header[r.header].append(unquote(r["_file"]))  # the path, not its URI
    return [_Files(spark, by_header[h.header], order) for h in headers]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _need(df: DataFrame, columns: tuple[str, ...], path: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"column {', '.join(missing)} not found in {path}")
    return df


def read_labelled(
    spark: SparkSession, paths: Mapping[str, str], *, text_col: str = "text", drop_empty: bool = False
) -> DataFrame:
    """Union of one CSV file or folder per label, as (text, label, other columns..). Files of a folder may differ in their
    headers; a column that a file lacks is null in its rows.

    A missing text column or an unreadable record fails the whole load. ``drop_empty=False`` keeps empty texts;
    ``True`` drops missing ones, among them the usual spellings of "no value", and finds an empty result an error.
    """
    parts = []
    for label, path in paths.items():
        for files in _files(spark, path):
            records = _need(files.records("FAILFAST").drop("_file", "_place"), (text_col,), path)
            named = records if text_col == "text" else records.withColumnRenamed(text_col, "text")
            parts.append(named.withColumn("label", F.lit(label)))
    union = _union(parts)
    if not drop_empty:
        return union.na.fill("", ["text"])
    kept = union.where(~F.col("text").isin(*MISSING_TEXTS)).dropna(subset=["text", "label"])
    if kept.isEmpty():
        raise ValueError("no valid data found")
    return kept


def _strict(parsed: Column, raw: Column, what: str) -> Column:
    message = F.concat(F.lit(f"not a valid {what}: "), F.coalesce(raw, F.lit("null")))
    return F.when(parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def read_behaviour(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, vehicle_id, behavior, seq): ids stay text (an empty one too), any bad value fails the load. ``seq`` grows
    with the name of the file and the place in it, and settles equal times."""
    files = _files(spark, path)
    stamp = F.to_timestamp_ntz("timestamp", F.lit(TIMESTAMP_FORMAT))
    number = F.trim("behavior").try_cast("int")
    rows = _union([
        _need(f.records("FAILFAST"), ("timestamp", "vehicle_id", "behavior"), path).select(
            _strict(stamp, F.col("timestamp"), "timestamp").alias("timestamp"),
            F.coalesce("vehicle_id", F.lit("")).alias("vehicle_id"),
            _strict(number, F.col("behavior"), "number").alias("behavior"), "_file", "_place")
        for f in files])
    return files[0].in_order(rows)


def read_source_events(
    spark: SparkSession, path: str, *, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine). Events are (source_id, title, text, prediction, timestamp, seq); a file without timestamp
    column gets ``now``. Rows whose prediction or time does not parse, or whose fields do not fit the header, go to the
    quarantine with a reason; good rows after a bad one are kept. A missing file has no events."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    empty = "source_id string, title string, text string, prediction int, timestamp timestamp_ntz, seq bigint"
    try:
        files = _files(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        none = spark.createDataFrame([], empty)
        return none, none.withColumn("reason", F.lit(""))

    def parsed(f: _Files) -> DataFrame:
        rows = _need(f.records("PERMISSIVE", "_record"), ("source_id", "prediction"), path)
        for c in ("title", "text"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        stamp = F.col("timestamp").try_cast("timestamp_ntz") if "timestamp" in rows.columns else now
        return rows.select(
            "source_id", "title", "text",
            F.trim("prediction").try_cast("int").alias("prediction"),
            stamp.alias("timestamp"),
            F.when(F.col("_record").isNotNull(), "fields do not fit the header").alias("_misfit"),
            "_file", "_place",
        )

    reason = F.coalesce(
        F.col("_misfit"),
        F.when(F.col("prediction").isNull(), "prediction is not a number"),
        F.when(F.col("timestamp").isNull(), "timestamp is not a time"),
    )
    judged = files[0].in_order(_union([parsed(f) for f in files])).withColumn("reason", reason).drop("_misfit")
    good = judged.where(F.col("reason").isNull()).select(*SOURCE_EVENT_COLUMNS, "seq")
    return good, judged.where(F.col("reason").isNotNull())
