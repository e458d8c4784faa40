"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str, of: str | None = None) -> Column:
    """The column of that very name, also if it holds dots or backticks; ``of``: the struct that holds it."""
    quoted = f"`{name.replace('`', '``')}`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct. Operators add their own columns beside it, so no name of the caller's can clash.
    The optimizer sees through the struct: columns that nobody reads are still not read from the files."""
    return df.select(F.struct(*(column(c) for c in df.columns)).alias(name))


def unpacked(df: DataFrame, columns: list[str], *, but: tuple[str, ...] = (), name: str = "row") -> list[Column]:
    """The caller's columns again, without those that the operator replaces."""
    return [column(c, name).alias(c) for c in columns if c not in but]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]
