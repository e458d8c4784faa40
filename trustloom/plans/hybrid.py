"""Content evidence and source trust in one verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.functions.scalar import blend, threshold_verdict
from trustloom.operators.graph import DEFAULT_TRUST
from trustloom.operators.lookup import bounded
from trustloom.operators.naive_bayes import NbModel, nb_score

def hybrid_verdict(
    content: DataFrame, trust: DataFrame, *, w_content: float = 0.7, w_source: float = 0.3
) -> DataFrame:
    """``content``: (.., source, p_fake); ``trust``: a written (node, trust), 0.5 for a source it does not have. Adds the verdict
    columns and the same as one struct ``result``."""
    known = trust.select(F.col("node").alias("source"), F.col("trust").alias("source_trust_score"))
    judged = (
        content.join(bounded(known, trust.count()), "source", "left")
        .withColumnRenamed("p_fake", "content_fake_score")
        .withColumn("source_trust_score", F.coalesce(F.col("source_trust_score"), F.lit(DEFAULT_TRUST)))
        .withColumn(
            "final_fake_score",
            blend(F.col("content_fake_score"), F.col("source_trust_score"), w_content, w_source),
        )
        .withColumn("verdict", threshold_verdict(F.col("final_fake_score")))
    )
    result = F.struct("verdict", "final_fake_score", "content_fake_score", "source_trust_score", "source")
    return judged.withColumn("result", result)


def hybrid(
    docs: DataFrame,
    model: NbModel,
    trust: DataFrame,
    *,
    id_col: str = "doc_id",
    w_content: float = 0.7,
    w_source: float = 0.3,
) -> DataFrame:
    """Score ``docs`` (id, source, tokens) with an unknown-word-skipping model and blend in the trust of the source."""
    content = nb_score(docs, model, id_col=id_col, keep=("source",), unknown="skip").select(id_col, "source", "p_fake")
    return hybrid_verdict(content, trust, w_content=w_content, w_source=w_source)
