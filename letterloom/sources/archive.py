"""The archive's tables: created once, filled by scans, each row written once.

Ids are hashes of what they name, so a repeated or re-run scan gives the same ids and the anti-joins
leave nothing to append.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions import text as T
from letterloom.operators.ingest import insert_or_ignore
from letterloom.session import cut

SCHEMAS = {
    "messages": "id long, account string, folder string, message_id string, subject string, from_email string, to_emails string, cc_emails string, date_ts long, in_reply_to string, has_attachments boolean, headers_json string",
    "attachments": "id long, message_id long, filename string, mime string, sha256 string, bytes long, path_original string, path_text string",
    "blobs": "sha256 string, bytes long, content binary",
    "chunks": "id long, message_id long, attachment_id long, kind string, text string",
    "chunk_vectors": "chunk_id long, model string, dim int, embedding array<float>",
    "seen_files": "path string, message_id string, size long, last_seen_ts timestamp",
    "attachment_jobs": "id long, status string, last_error string, tries int",
    "embedding_jobs": "id long, status string, last_error string, tries int",
    "postings": "term string, id long, tf long, dl int",
}


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables for those that ``folder`` lacks."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def safe_name(filename: Column) -> Column:
    """A file name without folders, drive or control characters; ``attachment`` if nothing is left."""
    base = F.regexp_replace(F.element_at(F.split(F.regexp_replace(filename, r"\\\\", "/"), "/"), -1), r"[\x00-\x1f:]", "")
    return F.when(base.isNull() | base.isin("", ".", ".."), "attachment").otherwise(base)


def append_new(spark: SparkSession, folder: str, name: str, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Appends the rows whose key the table lacks, the first per key; gives what was appended."""
    columns = [c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMAS[name])]
    fresh = cut(insert_or_ignore(rows, read(spark, folder, name), key, order).select(*columns))
    fresh.write.mode("append").parquet(f"{folder}/{name}")
    return fresh


def ingest(spark: SparkSession, parsed: DataFrame, folder: str) -> dict[str, int]:
    """Writes a scan of messages into the tables of ``folder``; gives the rows added per table.

    ``parsed`` is what the readers of :mod:`letterloom.sources.mail` give. The first message of an id
    wins. Attachments without content are skipped; equal contents are stored once and named once per
    message. New attachments and chunks get a pending job. Running the same scan again adds nothing.
    """
    create(spark, folder)
    scan = cut(parsed)
    new = cut(insert_or_ignore(scan, read(spark, folder, "messages"), "message_id", ["path"]).withColumn("id", F.xxhash64("message_id")))
    added = {"messages": append_new(spark, folder, "messages", new, "message_id", ["path"])}
    # A mail scanned again may have gained files beside it, so attachments are taken from the whole scan.
    files = scan.where("message_id IS NOT NULL").select(F.xxhash64("message_id").alias("message_id"), F.explode("attachments").alias("a")).where("a.bytes > 0")
    files = files.select("message_id", "a.*").withColumn("id", F.xxhash64("message_id", "sha256"))
    added["blobs"] = append_new(spark, folder, "blobs", files, "sha256", ["message_id"])
    named = files.select("id", "message_id", safe_name(F.col("filename")).alias("filename"), "mime", "sha256", "bytes").withColumn("path_original", F.concat_ws("/", F.lit("attachments"), "sha256", "filename")).withColumn("path_text", F.lit(None).cast("string"))
    added["attachments"] = append_new(spark, folder, "attachments", named, "id", ["filename"])
    job = lambda rows: rows.select("id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("last_error"), F.lit(0).alias("tries"))
    added["attachment_jobs"] = append_new(spark, folder, "attachment_jobs", job(added["attachments"]), "id", ["id"])

    body = new.select("id", F.posexplode(T.chunks(F.col("body"))).alias("n", "text")).select(F.xxhash64("id", F.lit("body"), "n").alias("cid"), "id", F.lit("body").alias("kind"), "text")
    names = F.array_join(F.transform("attachments", lambda a: a["filename"]), ", ")
    meta = new.select(F.xxhash64("id", F.lit("meta"), F.lit(0)).alias("cid"), "id", F.lit("meta").alias("kind"), T.meta_text(names, F.col("body")).alias("text"))
    chunks = body.unionByName(meta).select(F.col("cid").alias("id"), F.col("id").alias("message_id"), F.lit(None).cast("long").alias("attachment_id"), "kind", "text")
    added["chunks"] = append_new(spark, folder, "chunks", chunks, "id", ["id"])
    added["embedding_jobs"] = append_new(spark, folder, "embedding_jobs", job(added["chunks"]), "id", ["id"])
    terms = F.concat(T.terms(F.col("subject")), T.terms(F.col("body")))
    posted = new.select("id", terms.alias("ts")).select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")
    posted.write.mode("append").parquet(f"{folder}/postings")
    seen = scan.where("message_id IS NOT NULL").select("path", "message_id", F.length("body").cast("long").alias("size"), F.current_timestamp().alias("last_seen_ts"))
    added["seen_files"] = append_new(spark, folder, "seen_files", seen, "path", ["message_id"])
    return {name: rows.count() for name, rows in added.items()}


def hash_pending(spark: SparkSession, folder: str, dim: int = 64) -> int:
    """Vectors for the chunks that have none yet, written once; gives how many."""
    from letterloom.operators.vectors import hash_vectors

    have = read(spark, folder, "chunk_vectors").select(F.col("chunk_id").alias("id")).distinct()
    todo = read(spark, folder, "chunks").join(have, "id", "left_anti")
    rows = cut(hash_vectors(todo, "id", "text", dim).select(F.col("id").alias("chunk_id"), F.lit(f"hash{dim}").alias("model"), F.lit(dim).alias("dim"), F.col("embedding").cast("array<float>").alias("embedding")))
    rows.write.mode("append").parquet(f"{folder}/chunk_vectors")
    return rows.count()
