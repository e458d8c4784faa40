"""Scoring requests as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustloom.functions.scalar import is_fake
from trustloom.functions.text import Tokeniser, tokeniser
from trustloom.operators.naive_bayes import NbModel, nb_score
from trustloom.sources.requests import decode_requests, encode_reply
from trustloom.streaming.batches import put, run_batches


def score_texts(
    texts: DataFrame, model: NbModel, *, id_col: str, cleaner: str | Tokeniser = "a", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, keep.., verdict, prediction) for rows with a ``text``; the batch scoring, unknown words counted."""
    words = texts.select(id_col, *keep, tokeniser(cleaner)(F.col("text")).alias("tokens"))
    scored = nb_score(words, model, id_col=id_col, keep=keep)
    return scored.select(id_col, *keep, "verdict", is_fake(F.col("verdict")).alias("prediction"))


def scoring_stream(
    requests: DataFrame,
    model: NbModel,
    out: str,
    checkpoint: str,
    *,
    id_col: str,
    body_col: str = "body",
    cleaner: str | Tokeniser = "a",
) -> StreamingQuery:
    """Replies to ``out``/replies (id, reply), refused requests to ``out``/refused (id, reason)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_requests(batch.select(id_col, body_col), body_col)
        valid = decoded.where(F.col("reason").isNull())
        scored = score_texts(valid, model, id_col=id_col, cleaner=cleaner)
        put(scored.select(id_col, encode_reply(F.col("prediction")).alias("reply")), f"{out}/replies", batch_id)
        put(decoded.where(F.col("reason").isNotNull()).select(id_col, "reason"), f"{out}/refused", batch_id)

    return run_batches(requests, step, checkpoint)


def submission_stream(
    submissions: DataFrame,
    model: NbModel,
    out: str,
    checkpoint: str,
    *,
    id_col: str,
    cleaner: str | Tokeniser = "a",
) -> StreamingQuery:
    """Score submissions (id, source_id, text, timestamp) and append them to the log ``out``/log as trust events
    (id, source_id, timestamp, prediction). A submission without text is not scored and not logged. The log is the
    source of the trust stream, which has its own checkpoint."""

    def step(batch: DataFrame, batch_id: int) -> None:
        valid = batch.where(F.coalesce("text", F.lit("")) != "")
        scored = score_texts(valid, model, id_col=id_col, cleaner=cleaner, keep=("source_id", "timestamp"))
        put(scored.select(id_col, "source_id", "timestamp", "prediction"), f"{out}/log", batch_id)

    return run_batches(submissions, step, checkpoint)
