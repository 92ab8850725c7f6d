"""Mail search: hits with their messages, both ways of retrieval fused per message, boosted and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions import text as T
from letterloom.functions import values as V
from letterloom.operators import fusion, lexical

MESSAGE = ["subject", "from_email", "to_emails", "date_ts", "folder", "account"]


def first_bodies(parsed: DataFrame) -> DataFrame:
    """(message_id, body) of each message's first copy that has a body."""
    return parsed.where("body IS NOT NULL AND message_id IS NOT NULL").groupBy("message_id").agg(F.min_by("body", "parse_id").alias("body"))


def lexical_hits(in_messages: lexical.Index, in_chunks: lexical.Index, chunks: DataFrame, messages: DataFrame, bodies: DataFrame, question: list[str], k: int = 50) -> DataFrame:
    """The k best messages and chunks holding every term, with rank, snippet and the message's columns.

    A message goes before a chunk of equal score. Only the k hits meet the texts and messages: they are
    at most k rows and are broadcast. Chunks of unknown messages are left out.
    """
    of_messages = in_messages.search(question).select(F.lit("message").alias("type"), "id", F.lit(None).cast("long").alias("chunk_id"), F.round("score", 9).alias("score"))
    of_chunks = in_chunks.search(question).select(F.lit("chunk").alias("type"), F.col("id").alias("chunk_id"), F.round("score", 9).alias("score"))
    named = of_chunks.join(chunks.select(F.col("id").alias("chunk_id"), F.col("message_id").alias("id")), "chunk_id").select("type", "id", "chunk_id", "score")
    known = named.join(messages.select("id"), "id", "left_semi").select("type", "id", "chunk_id", "score")
    order = ["score", F.desc("type"), F.coalesce("chunk_id", "id")]
    best = of_messages.unionByName(known).orderBy(*order).limit(k)
    ranked = F.broadcast(best.withColumn("rank", F.row_number().over(Window.orderBy(*order))))
    met = messages.select("id", "message_id", *MESSAGE).join(ranked, "id")
    texts = bodies.join(F.broadcast(met.select("message_id").distinct()), "message_id", "left_semi")
    met = met.join(texts, "message_id", "left").join(chunks.select(F.col("id").alias("chunk_id"), "text").join(F.broadcast(best.select("chunk_id").distinct()), "chunk_id", "left_semi"), "chunk_id", "left")
    return met.select("type", "id", "chunk_id", "score", "rank", F.coalesce(T.shortened(F.coalesce("text", "body"), 160), F.lit("")).alias("snippet"), *MESSAGE)


def vector_hits(near: DataFrame, chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, chunk_id, rank, snippet) of the nearest chunks (vec_id, rank); chunks or messages that are gone are left out."""
    found = chunks.select(F.col("id").alias("vec_id"), "message_id", "text").join(F.broadcast(near.select("vec_id", "rank")), "vec_id")
    return found.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi").select(F.col("message_id").alias("id"), F.col("vec_id").alias("chunk_id"), "rank", F.coalesce(T.shortened(F.col("text"), 160), F.lit("")).alias("snippet"))


def fused_hits(words: DataFrame, near: DataFrame) -> DataFrame:
    """One row per message: both ranks, the fused score, and the hit that stands for it, full-text hits preferred."""
    fused = fusion.fuse(words.select("id", "rank"), near.select("id", "rank"), "id")
    hits = words.select("id", F.lit(0).alias("way"), "rank", "type", "chunk_id", "snippet").unionByName(near.select("id", F.lit(1).alias("way"), "rank", F.lit("chunk").alias("type"), "chunk_id", "snippet"))
    first = hits.groupBy("id").agg(F.min_by(F.struct("type", "chunk_id", "snippet"), F.struct("way", "rank")).alias("hit"))
    return fused.join(first, "id").select("id", "lexical_rank", "vector_rank", "score", "hit.*")


def boosted(hits: DataFrame, messages: DataFrame, counts: DataFrame, hypotheses: Column, softness: float = 1.0, folder: str = "", sender: str = "", attachment: float = 0.0, pdf: float = 0.0) -> DataFrame:
    """Adds the soft boosts to the score: the best of several times, attachments, PDFs, folder and sender."""
    met = messages.select("id", *MESSAGE).join(F.broadcast(hits), "id").join(counts.withColumnRenamed("message_id", "id"), "id", "left").fillna(0, ["attachments", "pdfs"])
    at = F.when(F.col("date_ts").between(1, 4102444800), F.to_date(F.timestamp_seconds("date_ts")))
    soft = lambda on, by: F.when(F.coalesce(on, F.lit(False)), by).otherwise(0.0)
    more = soft(F.col("attachments") > 0, attachment) + soft(F.col("pdfs") > 0, pdf)
    more = more + soft(F.lower("folder").endswith(folder.lower()), 0.05 if folder else 0.0) + soft(F.lower("from_email").contains(sender.lower()), 0.05 if sender else 0.0)
    return met.withColumn("score", F.round(F.col("score") + V.best_time_boost(at, hypotheses, softness) + more, 9))


def allowed(hits: DataFrame, checked: DataFrame) -> DataFrame:
    """Hits that ``checked`` (id, ok) does not forbid; those it does not know are kept."""
    return hits.join(checked.select("id", "ok"), "id", "left").where(F.coalesce("ok", F.lit(True))).drop("ok")
