"""Classification metrics as one row; fake is the positive class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def evaluate(predictions: DataFrame, *, label_col: str = "label", verdict_col: str = "verdict") -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1. Ratios without cases are 0; accuracy of no rows is null."""
    label, verdict = F.col(label_col), F.col(verdict_col)
    cells = predictions.agg(
        F.count_if((verdict == "fake") & (label == "fake")).alias("tp"),
        F.count_if((verdict == "fake") & (label == "real")).alias("fp"),
        F.count_if((verdict == "real") & (label == "fake")).alias("fn"),
        F.count_if((verdict == "real") & (label == "real")).alias("tn"),
        F.count("*").alias("_n"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = cells.select(
        "tp", "fp", "fn", "tn",
        _ratio(tp + tn, F.col("_n"), None).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _ratio(2 * (p * r), p + r))


def compare(predictions: dict[str, DataFrame], **columns: str) -> DataFrame:
    """One metric row per model."""
    rows = [evaluate(df, **columns).select(F.lit(name).alias("model"), "*") for name, df in predictions.items()]
    return reduce(DataFrame.unionByName, rows)
