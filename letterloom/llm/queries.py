"""The queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm import encoding, mixing, packing, personal, quality, replies, scans, splitting, tokens
from letterloom.session import cut, table


def _repaired(spark: SparkSession, d: str, keep_text: bool) -> DataFrame:
    subject = table(spark, d, "messages").select(F.lit("subject").alias("field"), F.col("id").alias("rec_id"), F.col("subject").alias("text"))
    body = table(spark, d, "parsed_messages").select(F.lit("body").alias("field"), F.col("parse_id").alias("rec_id"), F.col("body").alias("text"))
    texts = subject.unionByName(body)
    counts = {r["pair"]: r["n"] for r in encoding.pair_counts(texts, ["text"]).collect()}
    return encoding.repair(texts, "text", counts, keep_text).where("restored_words > 0 OR garbled_left")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d, keep_text=False).select("field", "rec_id").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d, keep_text=True).select("field", "rec_id", "restored", "garbled_left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return replies.find_older_lines(table(spark, d, "parsed_messages"), table(spark, d, "messages"))


def p4_new_text(spark: SparkSession, d: str) -> DataFrame:
    return replies.find_older_lines(table(spark, d, "parsed_messages"), table(spark, d, "messages"), reduced=True)


def _personal(spark: SparkSession, d: str, replaced: bool) -> DataFrame:
    body = table(spark, d, "parsed_messages").select(F.lit("body").alias("field"), F.col("parse_id").alias("rec_id"), F.col("body").alias("text"))
    chunk = table(spark, d, "chunks").select(F.lit("chunk").alias("field"), F.col("id").alias("rec_id"), "text")
    texts = body.unionByName(chunk).where("text IS NOT NULL AND text <> ''")
    return personal.find_personal(texts, personal.learn(texts, table(spark, d, "messages")), replaced)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, replaced=False).distinct()


def p5_replaced(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, replaced=True)


def _split(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "split_specs")
    body = table(spark, d, "parsed_messages").select(F.lit("body").alias("field"), F.col("parse_id").alias("rec_id"), F.lit("").alias("kind"), F.col("body").alias("text"))
    chunk = table(spark, d, "chunks").select(F.lit("chunk").alias("field"), F.col("id").alias("rec_id"), F.coalesce("kind", F.lit("")).alias("kind"), "text")
    limits = specs.select("field", F.coalesce("kind", F.lit("")).alias("kind"), "size_unit", "max_size", "overlap")
    texts = body.unionByName(chunk).join(limits, ["field", "kind"])
    return splitting.split_oversized(texts, "text", "size_unit", "max_size", "overlap")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).where("n_pieces > 1").select("field", "rec_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("field", "rec_id", "piece_no", "n_pieces", "shared", "piece")


def _pages(spark: SparkSession, d: str, repaired: bool, salt: int = 32) -> DataFrame:
    files = table(spark, d, "attachment_text").where("path_text IS NOT NULL").select(F.lit("attachment").alias("field"), F.col("path_text").alias("rec_key"), "text")
    pieces = table(spark, d, "chunks").where("kind = 'attachment'").select("id", "attachment_id", "text")
    model = scans.train(files.select("text"), files.select("text").unionByName(pieces.select("text")))
    # One attachment may hold a third of all pieces: they meet its few running lines under salted keys.
    shapes = scans.running_shapes(files, model).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    paths = table(spark, d, "attachments").where("path_text IS NOT NULL").select(F.col("id").alias("attachment_id"), F.col("path_text").alias("rec_key"))
    origin = paths.join(shapes, "rec_key").select("attachment_id", "salt", "shapes")
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
    cut_pieces = keyed.join(origin, ["attachment_id", "salt"], "left").select(F.lit("chunk").alias("field"), F.col("id").cast("string").alias("rec_key"), "text", "shapes", F.lit(True).alias("piece"))
    return scans.clean_pages(files.withColumn("shapes", F.lit(None).cast("array<string>")).withColumn("piece", F.lit(False)).unionByName(cut_pieces), model, repaired)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, repaired=False).distinct()


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, repaired=True)


def _doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return cut(docs.select("doc_id", "source", tokens.count_tokens(F.col("text")).alias("tokens")))


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """The container kinds: a fixed table of 4 rows, by TESTDATA.md."""
    return {r["container"]: r["capacity_tokens"] for r in table(spark, d, "pack_capacities").collect()}


def _targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    """The target shares: a fixed table of 8 rows, by TESTDATA.md."""
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, d, "mix_targets").collect()}


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_doc_tokens(spark, d), "doc_id", "tokens", _capacities(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, d), _capacities(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_doc_tokens(spark, d), "doc_id", "source", "tokens", _targets(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p9_mix(spark, d), _targets(spark, d))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    stats = cut(quality.document_statistics(table(spark, d, "documents"), "doc_id", "text", "lang"))
    return quality.classify(quality.standardise(stats, quality.language_sketches(stats)))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("text_class <> 'prose'").select("doc_id", "text_class").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_restored, p4_found, p4_new_text, p5_found, p5_replaced, p6_found, p6_pieces, p7_found, p7_repaired, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_scores)}

ORACLES: dict[str, str] = {
    "p6_found": r"""
        WITH texts AS (
          SELECT 'body' AS field, parse_id AS rec_id, '' AS kind, body AS text FROM parsed_messages
          UNION ALL SELECT 'chunk', id, coalesce(kind, ''), text FROM chunks)
        SELECT DISTINCT t.field, t.rec_id FROM texts t
        JOIN split_specs s ON s.field = t.field AND coalesce(s.kind, '') = t.kind
        WHERE CASE s.size_unit WHEN 'chars' THEN length(t.text) WHEN 'utf8_bytes' THEN strlen(t.text)
              ELSE len(regexp_extract_all(t.text, '[^ \t\r\n\f]+')) END > s.max_size""",
}
