"""Fusing ranked lists, boosting by soft constraints, filtering by hard ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def fuse(lexical: DataFrame, vector: DataFrame, key: str | list[str], k: int = RRF_K) -> DataFrame:
    """(key, lexical_rank, vector_rank, score): reciprocal rank fusion of two lists of (key, rank).

    With query_id among the keys, the lists of every query are fused at once.
    """
    keys = [key] if isinstance(key, str) else key
    a = lexical.groupBy(*keys).agg(F.min("rank").alias("lexical_rank"))
    b = vector.groupBy(*keys).agg(F.min("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, keys, "full_outer").withColumn("score", part("lexical_rank") + part("vector_rank"))


def attachment_counts(attachments: DataFrame) -> DataFrame:
    """(message_id, attachments, pdfs) of messages that have any."""
    return attachments.where("message_id IS NOT NULL").groupBy("message_id").agg(F.count("*").alias("attachments"), F.count_if(is_pdf()).alias("pdfs"))


def is_pdf() -> Column:
    return F.coalesce(F.col("mime").ilike("application/pdf%"), F.lit(False)) | F.coalesce(F.col("path_original").ilike("%.pdf"), F.lit(False))


def hard_filter(messages: DataFrame, folder: str | None = None, sender: str | None = None, senders: list[str] | None = None) -> DataFrame:
    """Messages whose folder ends with ``folder``, whose sender holds ``sender`` and is one of ``senders``, without case."""
    if senders:
        messages = messages.where(F.lower("from_email").isin([s.lower() for s in senders]))
    if folder:
        messages = messages.where(F.lower("folder").endswith(folder.lower()))
    if sender:
        messages = messages.where(F.lower("from_email").contains(sender.lower()))
    return messages
