"""Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan with fewer splits than cores, dealt out by ``key`` so that costly work per row uses all cores. A
    larger table already is spread and stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
