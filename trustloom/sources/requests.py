"""Scoring requests and replies as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.constants import INVALID_BODY, TEXT_REQUIRED


def decode_requests(requests: DataFrame, body_col: str = "body") -> DataFrame:
    """Adds ``text`` and ``reason``. The reason is null for a request that can be scored: a JSON object (or null) whose
    field ``text`` is a string, and that string not empty.

    The name of the field counts in any case. Of a field that stands there more than once the last value counts, but each
    must be a string or null, and a null changes nothing. Only the first JSON value of a body is looked at.
    """
    fields = F.map_entries(F.from_json(body_col, "map<string,variant>"))
    given = F.filter(fields, lambda f: (F.lower(f["key"]) == "text") & (F.schema_of_variant(f["value"]) != "VOID"))
    requests = requests.select("*", fields.isNotNull().alias("_object"), given.alias("_given"))
    empty = F.coalesce(F.schema_of_variant(F.try_parse_json(body_col)) == "VOID", F.lit(False))
    strings = ~F.exists("_given", lambda f: F.schema_of_variant(f["value"]) != "STRING")
    last = F.try_variant_get(F.get("_given", F.size("_given") - 1)["value"], "$", "string")
    text = F.when(F.col("_object") & strings, last)
    reason = (
        F.when(~(F.col("_object") | empty) | (F.col("_object") & ~strings), INVALID_BODY)
        .when(F.coalesce(text, F.lit("")) == "", TEXT_REQUIRED)
    )
    return requests.withColumns({"text": text, "reason": reason}).drop("_object", "_given")


def encode_reply(is_fake: Column) -> Column:
    return F.to_json(F.struct(is_fake.cast("int").alias("is_fake")))
