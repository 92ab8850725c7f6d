"""The core queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterloom.functions import text as T
from letterloom.functions import values as V
from letterloom.operators import fusion, ingest, instants, lexical, search, units, vectors
from letterloom.sources import archive
from letterloom.session import shared_folder, table
from letterloom.streaming import ingest as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTION = ["pump", "report"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.foreign_units(table(spark, d, "table_rows"), table(spark, d, "quantity_units"))


@query()
def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return units.convert_quantities(table(spark, d, "table_rows"), table(spark, d, "quantity_units"))


@query()
def p1_identities(spark: SparkSession, d: str) -> DataFrame:
    """Tables that state masses and volumes, with the unit combination that keeps to the density of water best."""
    return units.mass_and_volume(table(spark, d, "table_rows"), table(spark, d, "quantity_units"))


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.wrong_instants(table(spark, d, "messages"), table(spark, d, "site_zones"))


@query()
def p2_instants(spark: SparkSession, d: str) -> DataFrame:
    return instants.sending_instants(table(spark, d, "messages"), table(spark, d, "site_zones")).select("id", "date_ts", "sent_ts")


_TERMS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}\p{{Co}}._@\-]+')"


@query(f"SELECT term, count(*) AS docs, sum(tf)::BIGINT AS occurrences FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(table(spark, d, "documents"), "doc_id", ["text"]).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query(r"""SELECT id, coalesce(array_to_string(list_filter(regexp_extract_all(strip_accents(lower(subject)), '[\p{L}\p{N}_@.\-]+'), lambda t: length(t) >= 2), ' AND '), '') AS expression FROM messages""")
def fts_query_build(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", T.match_expression(F.col("subject")).alias("expression"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TERMS.format('text')} AS ts FROM documents) WHERE list_contains(ts, 'pump') AND list_contains(ts, 'report')")
def fts_match_and(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).search(QUESTION).select("doc_id")


def _documents(spark: SparkSession, d: str) -> lexical.Index:
    return lexical.index_of(spark, "documents", table(spark, d, "documents"), "doc_id", ["text"])


def _chunks(spark: SparkSession, d: str) -> lexical.Index:
    return lexical.index_of(spark, "chunks", table(spark, d, "chunks").select("id", "text"), "id", ["text"])


_BM25 = """
    SELECT {key}, round(-(sum(w)), 9) AS score FROM (
      SELECT {key}, dl, term, tf, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w
      FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(ts) AS dl, unnest(ts) AS term FROM {docs}) WHERE term IN ('pump', 'report') GROUP BY ALL)),
           (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {docs}))
    GROUP BY {key} HAVING count(*) = 2"""
_DOC_TERMS = f"(SELECT doc_id, {_TERMS.format('text')} AS ts FROM documents)"
_CHUNK_TERMS = f"(SELECT id, coalesce({_TERMS.format('text')}, []) AS ts FROM chunks)"


@query(f"SELECT *, row_number() OVER (ORDER BY score, doc_id)::INT AS rank FROM ({_BM25.format(key='doc_id', docs=_DOC_TERMS)}) ORDER BY score, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = _documents(spark, d).search(QUESTION)
    return lexical.top(scored.withColumn("score", F.round("score", 9)), "doc_id", 20)


@query(f"""SELECT * FROM (SELECT 'document' AS source, doc_id AS id, score FROM ({_BM25.format(key='doc_id', docs=_DOC_TERMS)})
    UNION ALL SELECT 'chunk', id, score FROM ({_BM25.format(key='id', docs=_CHUNK_TERMS)})) ORDER BY score, source DESC, id LIMIT 20""")
def lexical_union(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).search(QUESTION).select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    chunks = _chunks(spark, d).search(QUESTION).select(F.lit("chunk").alias("source"), "id", F.round("score", 9).alias("score"))
    return docs.unionByName(chunks).orderBy("score", F.desc("source"), "id").limit(20)


_L2 = "round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 9)"
_KNN = f"SELECT q.vec_id AS query_id, v.vec_id, {_L2} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, v.vec_id)::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"


def _knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 10)


@query(f"SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM ({_KNN})")
def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d).withColumn("distance", F.round("distance", 6))


@query(f"SELECT vec_id, round(min(distance), 6) AS distance, min(rank) AS rank, count(*) AS queries FROM ({_KNN}) GROUP BY vec_id")
def knn_multi_query_best(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d).groupBy("vec_id").agg(F.round(F.min("distance"), 6).alias("distance"), F.min("rank").alias("rank"), F.count("*").alias("queries"))


_LEX = f"(SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM ({_BM25.format(key='doc_id', docs=_DOC_TERMS)}) ORDER BY score, doc_id LIMIT 50)"
_VEC = f"(SELECT v.vec_id AS doc_id, row_number() OVER (ORDER BY {_L2}, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id = 0 ORDER BY {_L2}, v.vec_id LIMIT 100)"
_FUSED = f"SELECT doc_id, a.rank::INT AS lexical_rank, b.rank::INT AS vector_rank, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score FROM {_LEX} a FULL JOIN {_VEC} b USING (doc_id)"


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for messages; the vector with a document's number is its embedding."""
    scored = _documents(spark, d).search(QUESTION)
    words = lexical.top(scored.withColumn("score", F.round("score", 9)), "doc_id", 50)
    e = table(spark, d, "embeddings")
    near = vectors.nearest(e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 100)
    return fusion.fuse(words.select("doc_id", "rank"), near.select(F.col("vec_id").alias("doc_id"), "rank"), "doc_id")


@query(f"SELECT doc_id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(vector_rank, 0) AS vector_rank, round(score, 9) AS score FROM ({_FUSED})")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fused ranks; 0 stands for a list that lacks the document."""
    return _fused(spark, d).fillna(0, ["lexical_rank", "vector_rank"]).withColumn("score", F.round("score", 9))


_BOOST = """CASE WHEN day IS NULL THEN 0 WHEN day BETWEEN DATE '2023-01-01' AND DATE '2023-12-31' THEN 0.8
    ELSE 0.8 * pow(2.71828, -(least(abs(date_diff('day', DATE '2023-01-01', day)), abs(date_diff('day', DATE '2023-12-31', day))) / 30.0) / 2.0) END"""


@query(f"""SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (
    SELECT f.doc_id, round(f.score + {_BOOST} + CASE WHEN lower(folder) LIKE '%inbox' THEN 0.05 ELSE 0 END + CASE WHEN contains(lower(from_email), 'norhaven') THEN 0.05 ELSE 0 END, 9) AS score
    FROM ({_FUSED}) f JOIN (SELECT *, created_at::DATE AS day FROM documents) d ON d.doc_id = f.doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_boosted(spark: SparkSession, d: str) -> DataFrame:
    scored = _boosted(_fused(spark, d), spark, d)
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def _boosted(fused: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Fused documents with their soft boosts added to the score, other ranks dropped."""
    docs = table(spark, d, "documents").select("doc_id", "folder", "from_email", F.to_date("created_at").alias("at"))
    boost = V.time_boost(F.col("at"), F.lit("2023-01-01").cast("date"), F.lit("2023-12-31").cast("date"), 0.8)
    soft = F.when(F.lower("folder").endswith("inbox"), 0.05).otherwise(0.0) + F.when(F.lower("from_email").contains("norhaven"), 0.05).otherwise(0.0)
    keys = [c for c in ("query_id", "doc_id") if c in fused.columns]
    return fused.join(docs, "doc_id").select(*keys, F.round(F.col("score") + boost + soft, 9).alias("score"))


# The searches above ask one fixed question; these ask every document whose id is divisible by 100, by its terms and its vector.
_BM25_EACH = """
    SELECT query_id, {key}, round(-(sum(w)), 9) AS score FROM (
      SELECT query_id, {key}, wanted, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w
      FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS wanted FROM (SELECT DISTINCT doc_id AS query_id, unnest(ts) AS term FROM {asked} WHERE doc_id % 100 = 0)) q
      JOIN (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(ts) AS dl, unnest(ts) AS term FROM {docs}) GROUP BY ALL)) p ON p.term = q.term,
           (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {docs}))
    GROUP BY query_id, {key}, wanted HAVING count(*) = wanted"""
_DOCS_EACH = _BM25_EACH.format(key="doc_id", docs=_DOC_TERMS, asked=_DOC_TERMS)
_LEX_EACH = f"(SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INT AS rank FROM ({_DOCS_EACH}) QUALIFY rank <= 50)"
_VEC_EACH = f"(SELECT query_id, doc_id, n AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, v.vec_id)::INT AS n FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE n <= 100)"
_FUSED_EACH = f"SELECT query_id, doc_id, a.rank AS lexical_rank, b.rank AS vector_rank, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score FROM {_LEX_EACH} a FULL JOIN {_VEC_EACH} b USING (query_id, doc_id)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_distinct(T.terms(F.col("text"))).alias("terms"))


def _search_each(spark: SparkSession, d: str, name: str, key: str, k: int | None = None, snippet: int | None = None) -> DataFrame:
    return lexical.search_each(table(spark, d, name), key, ["text"], _asked(spark, d), k, snippet)


@query(f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INT AS rank FROM ({_DOCS_EACH}) QUALIFY rank <= 20")
def bm25_topk_each(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_each(_search_each(spark, d, "documents", "doc_id", 20), ["score", "doc_id"], 20)


@query(f"""SELECT query_id, source, id, score FROM (SELECT query_id, 'document' AS source, doc_id AS id, score FROM ({_DOCS_EACH})
    UNION ALL SELECT query_id, 'chunk', id, score FROM ({_BM25_EACH.format(key='id', docs=_CHUNK_TERMS, asked=_DOC_TERMS)})) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, source DESC, id) <= 20""")
def lexical_union_each(spark: SparkSession, d: str) -> DataFrame:
    docs = _search_each(spark, d, "documents", "doc_id", 20).select("query_id", F.lit("document").alias("source"), F.col("doc_id").alias("id"), "score")
    chunks = _search_each(spark, d, "chunks", "id", 20).select("query_id", F.lit("chunk").alias("source"), "id", "score")
    return lexical.top_each(docs.unionByName(chunks), ["score", F.desc("source"), "id"], 20).drop("rank")


def _fused_each(spark: SparkSession, d: str) -> DataFrame:
    words = lexical.top_each(_search_each(spark, d, "documents", "doc_id", 50), ["score", "doc_id"], 50)
    e = table(spark, d, "embeddings")
    near = vectors.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 100)
    return fusion.fuse(words, near.withColumnRenamed("vec_id", "doc_id"), ["query_id", "doc_id"])


@query(f"SELECT query_id, doc_id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(vector_rank, 0) AS vector_rank, round(score, 9) AS score FROM ({_FUSED_EACH})")
def rrf_fusion_each(spark: SparkSession, d: str) -> DataFrame:
    return _fused_each(spark, d).fillna(0, ["lexical_rank", "vector_rank"]).withColumn("score", F.round("score", 9))


@query(f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
    SELECT f.query_id, f.doc_id, round(f.score + {_BOOST} + CASE WHEN lower(folder) LIKE '%inbox' THEN 0.05 ELSE 0 END + CASE WHEN contains(lower(from_email), 'norhaven') THEN 0.05 ELSE 0 END, 9) AS score
    FROM ({_FUSED_EACH}) f JOIN (SELECT *, created_at::DATE AS day FROM documents) d ON d.doc_id = f.doc_id) QUALIFY rank <= 20""")
def hybrid_boosted_each(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_each(_boosted(_fused_each(spark, d), spark, d), [F.desc("score"), "doc_id"], 20)


# Mail search: messages and chunks by their words, chunks by their vectors (a vector has its chunk's number).
_BODIES = "(SELECT message_id, arg_min(body, parse_id) AS body FROM parsed_messages WHERE body IS NOT NULL AND message_id IS NOT NULL GROUP BY message_id)"
_MAIL_TERMS = f"(SELECT id, list_concat(coalesce({_TERMS.format('subject')}, []), coalesce({_TERMS.format('body')}, [])) AS ts FROM messages LEFT JOIN {_BODIES} USING (message_id))"
_SHORT = "coalesce(CASE WHEN length({0}) > 160 THEN concat(substr({0}, 1, 160), '…') ELSE {0} END, '')"
_HITS = f"""(SELECT h.*, m.subject, m.from_email, m.to_emails, m.date_ts, m.folder, m.account, {_SHORT.format('coalesce(c.text, b.body)')} AS snippet FROM (SELECT *, row_number() OVER (ORDER BY score, type DESC, ref)::INT AS rank FROM
    (SELECT 'message' AS type, id, NULL::BIGINT AS chunk_id, id AS ref, score FROM ({_BM25.format(key='id', docs=_MAIL_TERMS)}) UNION ALL SELECT 'chunk', c.message_id, c.id, c.id, score FROM ({_BM25.format(key='id', docs=_CHUNK_TERMS)}) s JOIN chunks c ON c.id = s.id WHERE c.message_id IN (SELECT id FROM messages)) QUALIFY rank <= 50) h
    JOIN messages m ON m.id = h.id LEFT JOIN {_BODIES} b ON b.message_id = m.message_id LEFT JOIN chunks c ON c.id = h.chunk_id)"""
_NEAR = f"(SELECT c.message_id AS id, c.id AS chunk_id, v.rank::INT AS rank, {_SHORT.format('c.text')} AS snippet FROM {_VEC} v JOIN chunks c ON c.id = v.doc_id WHERE c.message_id IN (SELECT id FROM messages))"
_MAIL_FUSED = f"""(SELECT * FROM (SELECT id, a.rank AS lexical_rank, b.rank AS vector_rank, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score FROM (SELECT id, min(rank) AS rank FROM {_HITS} GROUP BY id) a FULL JOIN (SELECT id, min(rank) AS rank FROM {_NEAR} GROUP BY id) b USING (id))
    JOIN (SELECT id, type, chunk_id, snippet FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way, rank) AS n FROM (SELECT id, 0 AS way, rank, type, chunk_id, snippet FROM {_HITS} UNION ALL SELECT id, 1, rank, 'chunk', chunk_id, snippet FROM {_NEAR})) WHERE n = 1) USING (id))"""


def _mail(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "messages"), table(spark, d, "chunks"), search.first_bodies(table(spark, d, "parsed_messages"))


def _mail_index(spark: SparkSession, d: str) -> lexical.Index:
    messages, _, bodies = _mail(spark, d)
    return lexical.index_of(spark, "mails", messages.select("id", "message_id", "subject").join(bodies, "message_id", "left"), "id", ["subject", "body"])


def _words(spark: SparkSession, d: str) -> DataFrame:
    messages, chunks, bodies = _mail(spark, d)
    return search.lexical_hits(_mail_index(spark, d), _chunks(spark, d), chunks, messages, bodies, QUESTION)


def _near(spark: SparkSession, d: str) -> DataFrame:
    messages, chunks, _ = _mail(spark, d)
    e = table(spark, d, "embeddings")
    near = vectors.nearest(e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 100)
    return search.vector_hits(near, chunks, messages)


@query(f"SELECT type, id, coalesce(chunk_id, -1) AS chunk_id, score, rank, snippet, subject, from_email, to_emails, date_ts, folder, account FROM {_HITS}")
def mail_hits(spark: SparkSession, d: str) -> DataFrame:
    """Messages and chunks that hold the question's words, with their messages."""
    return _words(spark, d).fillna(-1, ["chunk_id"])


@query(f"SELECT id, chunk_id, rank, snippet FROM {_NEAR}")
def vector_hit_messages(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


@query(f"SELECT id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(vector_rank, 0) AS vector_rank, round(score, 9) AS score, type, coalesce(chunk_id, -1) AS chunk_id, snippet FROM {_MAIL_FUSED}")
def mail_fused(spark: SparkSession, d: str) -> DataFrame:
    """One row per message found either way, with the hit that stands for it."""
    fused = search.fused_hits(_words(spark, d), _near(spark, d))
    return fused.fillna(0, ["lexical_rank", "vector_rank"]).fillna(-1, ["chunk_id"]).withColumn("score", F.round("score", 9))


_TIMES = [("2023-01-01", "2023-12-31", 0.8), ("2021-06-01", "2021-06-30", 0.5), ("2024-03-01", "2024-05-31", 0.9)]
_BEST = "greatest(" + ", ".join(f"CASE WHEN day BETWEEN DATE '{a}' AND DATE '{b}' THEN {w} ELSE {w} * pow(2.71828, -(least(abs(date_diff('day', DATE '{a}', day)), abs(date_diff('day', DATE '{b}', day))) / 30.0) / 2.0) END" for a, b, w in _TIMES) + ")"


@query(f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, type, coalesce(chunk_id, -1) AS chunk_id, subject, from_email, snippet FROM (
    SELECT *, round(fused + CASE WHEN day IS NULL THEN 0 ELSE {_BEST} END + CASE WHEN attachments > 0 THEN 0.1 ELSE 0 END + CASE WHEN pdfs > 0 THEN 0.05 ELSE 0 END + CASE WHEN lower(folder) LIKE '%inbox' THEN 0.05 ELSE 0 END + CASE WHEN contains(lower(from_email), 'norhaven') THEN 0.05 ELSE 0 END, 9) AS score FROM (
    SELECT f.id, f.score AS fused, f.type, f.chunk_id, f.snippet, m.subject, m.from_email, m.folder, CASE WHEN m.date_ts BETWEEN 1 AND 4102444800 THEN (to_timestamp(m.date_ts) AT TIME ZONE 'UTC')::DATE END AS day, coalesce(attachments, 0) AS attachments, coalesce(pdfs, 0) AS pdfs FROM {_MAIL_FUSED} f JOIN messages m ON m.id = f.id
    LEFT JOIN (SELECT message_id, count(*) AS attachments, count(*) FILTER (coalesce(mime ILIKE 'application/pdf%', false) OR coalesce(path_original ILIKE '%.pdf', false)) AS pdfs FROM attachments GROUP BY 1) a ON a.message_id = m.id
    WHERE coalesce(m.from_email IS NULL OR lower(m.from_email) NOT LIKE '%freemailbox%', true))) ORDER BY score DESC, id LIMIT 20""")
def mail_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both ways of retrieval fused per message, boosted by times, attachments, folder and sender, filtered."""
    messages = table(spark, d, "messages")
    times = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(w).alias("weight")) for a, b, w in _TIMES))
    fused = search.fused_hits(_words(spark, d), _near(spark, d))
    scored = search.boosted(fused, messages, fusion.attachment_counts(table(spark, d, "attachments")), times, folder="inbox", sender="norhaven", attachment=0.1, pdf=0.05)
    checked = messages.select("id", (~F.lower("from_email").contains("freemailbox")).alias("ok")).where("ok IS NOT NULL")
    best = search.allowed(scored, checked).orderBy(F.desc("score"), "id").limit(20)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).fillna(-1, ["chunk_id"]).select("id", "score", "rank", "type", "chunk_id", "subject", "from_email", "snippet")


@query(f"SELECT DISTINCT a.id, a.message_id, a.filename, a.path_original FROM attachments a WHERE (mime ILIKE 'application/pdf%' OR path_original ILIKE '%.pdf') AND message_id IN (SELECT id FROM {_HITS})")
def hit_pdfs(spark: SparkSession, d: str) -> DataFrame:
    """PDFs of the messages that a search found."""
    hits = _words(spark, d).select(F.col("id").alias("message_id")).distinct()
    return table(spark, d, "attachments").where(fusion.is_pdf()).join(F.broadcast(hits), "message_id", "left_semi").select("id", "message_id", "filename", "path_original")


@query(f"SELECT id FROM {_MAIL_FUSED} WHERE id NOT IN (SELECT id FROM messages WHERE date_ts > 0 AND date_ts < 1672531200)")
def unknown_kept(spark: SparkSession, d: str) -> DataFrame:
    """A hard filter by time keeps messages whose time is unknown."""
    fused = search.fused_hits(_words(spark, d), _near(spark, d))
    checked = table(spark, d, "messages").where("date_ts > 0").select("id", (F.col("date_ts") >= 1672531200).alias("ok"))
    return search.allowed(fused, checked).select("id")


@query("SELECT list_sort(list_distinct([lower(subject) FOR subject IN list(subject)]))[1] AS first_query, count(DISTINCT lower(trim(subject))) AS queries FROM (SELECT subject FROM messages WHERE trim(subject) <> '' UNION ALL SELECT text FROM (SELECT substr(text, 1, 40) AS text FROM documents) WHERE trim(text) <> '')")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    """Query texts from two sources, each once."""
    subjects = table(spark, d, "messages").where("trim(subject) <> ''").select(F.col("subject").alias("q"))
    heads = table(spark, d, "documents").select(F.substring("text", 1, 40).alias("q")).where("trim(q) <> ''")
    every = subjects.unionByName(heads)
    return every.agg(F.min(F.lower("q")).alias("first_query"), F.countDistinct(F.lower(F.trim("q"))).alias("queries"))


@query("SELECT id, folder, from_email FROM messages WHERE lower(folder) LIKE '%inbox' AND contains(lower(from_email), 'norhaven') AND id IN (SELECT message_id FROM attachments)")
def hard_filters(spark: SparkSession, d: str) -> DataFrame:
    kept = fusion.hard_filter(table(spark, d, "messages"), "inbox", "norhaven")
    return kept.join(table(spark, d, "attachments").select(F.col("message_id").alias("id")), "id", "left_semi").select("id", "folder", "from_email")


@query(f"SELECT o_orderkey, round({_BOOST}, 9) AS boost FROM (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders)")
def temporal_boost(spark: SparkSession, d: str) -> DataFrame:
    boost = V.time_boost(F.to_date("o_orderdate"), F.lit("2023-01-01").cast("date"), F.lit("2023-12-31").cast("date"), 0.8)
    return table(spark, d, "orders").select("o_orderkey", F.round(boost, 9).alias("boost"))


@query(r"""WITH RECURSIVE p AS (SELECT parse_id, pos, trim(p, E' \t\r\n\f') AS p FROM (SELECT parse_id, unnest(regexp_split_to_array(body, '\n{2,}')) AS p, generate_subscripts(regexp_split_to_array(body, '\n{2,}'), 1) AS pos FROM parsed_messages WHERE body IS NOT NULL)),
    q AS (SELECT parse_id, row_number() OVER (PARTITION BY parse_id ORDER BY pos) AS i, p FROM p WHERE p <> ''),
    f AS (SELECT parse_id, i, 1 AS chunk_no, length(p) + 2 AS size FROM q WHERE i = 1
      UNION ALL SELECT q.parse_id, q.i, CASE WHEN f.size + length(q.p) > 800 THEN f.chunk_no + 1 ELSE f.chunk_no END, CASE WHEN f.size + length(q.p) > 800 THEN 0 ELSE f.size END + length(q.p) + 2
      FROM f JOIN q ON q.parse_id = f.parse_id AND q.i = f.i + 1)
    SELECT parse_id, chunk_no::INT AS chunk_no, string_agg(q.p, E'\n\n' ORDER BY i) AS text FROM f JOIN q USING (parse_id, i) GROUP BY parse_id, chunk_no""")
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "parsed_messages").select("parse_id", F.posexplode(T.chunks(F.col("body"))).alias("n", "text"))
    return cut.select("parse_id", (F.col("n") + 1).alias("chunk_no"), "text")


@query("SELECT parse_id, k::INT AS piece_no, substr(body, 800 * (k - 1) + 1, 800) AS text FROM parsed_messages, unnest(range(1, (length(body) + 799) // 800 + 1)) AS t(k) WHERE length(body) > 0")
def chunk_hard_split(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "parsed_messages").where("length(body) > 0")
    return long.select("parse_id", "body", F.explode(F.sequence(F.lit(1), F.ceil(F.length("body") / 800).cast("int"))).alias("piece_no")).select("parse_id", "piece_no", F.expr("substring(body, 800 * (piece_no - 1) + 1, 800)").alias("text"))


_ENTITY_SQL = "{}"
for _name, _char in T.ENTITIES.items():
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '{_name.replace(chr(39), chr(39) * 2)}', '{_char.replace(chr(39), chr(39) * 2)}')"
_TAGS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<br\s*/?>', E'\n', 'g'), '(?i)</p\s*>', E'\n\n', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT doc_id, trim(regexp_replace({_ENTITY_SQL.format(_TAGS)}, '[ \\t\\r\\n\\f\\x0b\\x{{a0}}]+', ' ', 'g')) AS plain FROM documents")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.html_to_text(F.col("text")).alias("plain"))


@query("""SELECT m.id, concat('SUBJECT: ', coalesce(subject, ''), E'\\nFROM: ', coalesce(from_email, ''), E'\\nTO: ', coalesce(to_emails, ''), E'\\nCC: ', coalesce(cc_emails, ''), E'\\nFOLDER: ', coalesce(folder, ''), E'\\nATTACHMENTS: ', coalesce(names, ''),
    CASE WHEN body <> '' THEN concat(E'\\nBODY: ', substr(body, 1, 500)) ELSE '' END) AS text FROM messages m
    LEFT JOIN (SELECT message_id, string_agg(filename, ', ' ORDER BY id) AS names FROM attachments WHERE filename IS NOT NULL GROUP BY message_id) a ON a.message_id = m.id
    LEFT JOIN (SELECT message_id, arg_min(body, parse_id) AS body FROM (SELECT * FROM parsed_messages WHERE body IS NOT NULL) GROUP BY message_id) p ON p.message_id = m.message_id""")
def meta_chunk(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "attachments").where("filename IS NOT NULL").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("id", "filename"))).alias("a")).select(F.col("message_id").alias("id"), F.array_join(F.transform("a", lambda x: x["filename"]), ", ").alias("names"))
    bodies = table(spark, d, "parsed_messages").where("body IS NOT NULL").groupBy("message_id").agg(F.min_by(F.substring("body", 1, 500), "parse_id").alias("body"))
    m = table(spark, d, "messages").join(names, "id", "left").join(bodies, "message_id", "left")
    return m.select("id", T.meta_text(F.col("names"), F.col("body")).alias("text"))


_CELLS_OF = "(SELECT id, (unicode(c)::BIGINT * 1315423911 + (i - 1) * 2654435761) % 64 AS cell, count(*) AS n FROM (SELECT id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM chunks WHERE length(text) > 0) GROUP BY ALL)"


@query(f"SELECT id, cell, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS weight FROM {_CELLS_OF}")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each chunk's unit vector that are not zero."""
    v = vectors.hash_vectors(table(spark, d, "chunks"), "id", "text", 64)
    return v.select("id", F.posexplode("embedding").alias("cell", "weight")).where("weight > 0").select("id", F.col("cell").cast("long").alias("cell"), F.round("weight", 9).alias("weight"))


@query("SELECT vec_id, round(list_sum(list_transform(h, lambda x: x / n)), 6) AS total, round(list_max(h) / n, 6) AS largest FROM (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS h FROM embeddings))")
def truncate_vectors(spark: SparkSession, d: str) -> DataFrame:
    half = table(spark, d, "embeddings").select("vec_id", vectors.truncated(F.col("embedding"), 32).alias("h"))
    return half.select("vec_id", F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("h"), 6).alias("largest"))


@query("SELECT sha256, min(id) AS first_id, count(*) AS copies, count(DISTINCT message_id) AS messages FROM attachments WHERE sha256 IS NOT NULL GROUP BY sha256")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attachments").where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.countDistinct("message_id").alias("messages"))


@query("SELECT parse_id, message_id, path FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY scanned_at NULLS FIRST, path NULLS FIRST, parse_id) AS n FROM parsed_messages WHERE message_id IS NOT NULL) p WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT in_reply_to FROM messages) m WHERE m.in_reply_to = p.message_id)")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Arriving mails, first copy each, that the table of answered mails does not hold."""
    answered = table(spark, d, "messages").select(F.col("in_reply_to").alias("message_id"))
    return ingest.insert_or_ignore(table(spark, d, "parsed_messages"), answered, "message_id", ["scanned_at", "path", "parse_id"]).select("parse_id", "message_id", "path")


@query("SELECT parse_id, concat('synthetic-', sha256(concat(coalesce(subject, ''), '|', coalesce(from_email, ''), '|', coalesce(to_emails, ''), '|', date_ts, '|', sha256(coalesce(body, ''))))) AS synthetic_id FROM parsed_messages JOIN messages USING (message_id)")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id that the parser gives a message without one, from what it says."""
    of = lambda c: F.coalesce(c, F.lit(""))
    m = table(spark, d, "parsed_messages").select("parse_id", "message_id", "body").join(table(spark, d, "messages").select("message_id", "subject", "from_email", "to_emails", "date_ts"), "message_id")
    return m.select("parse_id", F.concat(F.lit("synthetic-"), F.sha2(F.concat_ws("|", of("subject"), of("from_email"), of("to_emails"), F.col("date_ts").cast("string"), F.sha2(of("body"), 256)), 256)).alias("synthetic_id"))


@query(r"SELECT id, CASE WHEN b IS NULL OR b IN ('', '.', '..') THEN 'attachment' ELSE b END AS safe FROM (SELECT id, regexp_replace(list_extract(string_split(replace(filename, '\\', '/'), '/'), -1), '[\x00-\x1f:]', '', 'g') AS b FROM attachments)")
def safe_basenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attachments").select("id", archive.safe_name(F.col("filename")).alias("safe"))


@query("SELECT id FROM chunks WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def embed_backlog(spark: SparkSession, d: str) -> DataFrame:
    return ingest.backlog(table(spark, d, "chunks"), "id", table(spark, d, "embeddings"), "vec_id").select("id")


@query("SELECT path, arg_max(parse_id, (scanned_at, parse_id)) AS parse_id, max(scanned_at) AS scanned_at FROM parsed_messages WHERE path IS NOT NULL GROUP BY path")
def seen_files_upsert(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest_scan(table(spark, d, "parsed_messages").select("path", "parse_id", "scanned_at"), "path", "scanned_at", "parse_id")


@query("SELECT parse_id, path FROM (SELECT parse_id, path, coalesce(length(body), 0) AS size, scanned_at, count(*) OVER w AS earlier, lag(coalesce(length(body), 0)) OVER w AS b, lag(scanned_at) OVER w AS t FROM parsed_messages WHERE path IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY scanned_at NULLS FIRST, parse_id)) WHERE earlier > 1 AND (b <> size OR t IS DISTINCT FROM scanned_at)")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Scans of a path seen before whose size or time differs from the scan before."""
    scans = table(spark, d, "parsed_messages").select("parse_id", "path", "scanned_at", F.coalesce(F.length("body"), F.lit(0)).alias("size"))
    return ingest.changed(scans, "path", "scanned_at", "parse_id", ["size", "scanned_at"]).select("parse_id", "path")


@query("SELECT id, path_text FROM attachments a WHERE path_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.attachment_id = a.id) ORDER BY id LIMIT 50")
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "chunks").where("attachment_id IS NOT NULL")
    return ingest.backlog(table(spark, d, "attachments").where("path_text IS NOT NULL"), "id", done, "attachment_id").orderBy("id").limit(50).select("id", "path_text")


@query("""SELECT CASE WHEN path_text IS NULL THEN 'error' WHEN id IN (SELECT attachment_id FROM chunks WHERE attachment_id IS NOT NULL) THEN 'done' ELSE 'pending' END AS status, count(*) AS jobs FROM attachments GROUP BY 1""")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "chunks").where("attachment_id IS NOT NULL").select(F.col("attachment_id").alias("id"), F.lit(True).alias("done")).distinct()
    jobs = table(spark, d, "attachments").join(done, "id", "left")
    return jobs.groupBy(F.when(F.col("path_text").isNull(), "error").when(F.col("done"), "done").otherwise("pending").alias("status")).agg(F.count("*").alias("jobs"))


@query("SELECT label, len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY ALL ORDER BY n DESC, label, dim LIMIT 1")
def dominant_model(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dim").limit(1)


@query("SELECT m.id, coalesce(attachments, 0) AS attachments, coalesce(pdfs, 0) AS pdfs FROM messages m LEFT JOIN (SELECT message_id, count(*) AS attachments, count(*) FILTER (coalesce(mime ILIKE 'application/pdf%', false) OR coalesce(path_original ILIKE '%.pdf', false)) AS pdfs FROM attachments GROUP BY 1) a ON a.message_id = m.id")
def attachment_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = fusion.attachment_counts(table(spark, d, "attachments")).withColumnRenamed("message_id", "id")
    return table(spark, d, "messages").select("id").join(counts, "id", "left").fillna(0)


@query("SELECT id, filename FROM attachments WHERE mime ILIKE 'application/pdf%' OR path_original ILIKE '%.pdf'")
def pdf_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attachments").where(fusion.is_pdf()).select("id", "filename")


_CELLS = "(SELECT row_id, year, e.key AS name, e.value AS cell FROM (SELECT row_id, year, unnest(map_entries(data)) AS e FROM table_rows))"
_NUMBER = r"""CASE WHEN regexp_full_match(s, '-?\d{1,3}(\.\d{3})+,\d+') THEN replace(replace(s, '.', ''), ',', '.')::DOUBLE WHEN regexp_full_match(s, '-?\d{1,3}(,\d{3})+') THEN replace(s, ',', '')::DOUBLE
    WHEN regexp_full_match(s, '-?\d{1,3},\d{1,2}') THEN replace(s, ',', '.')::DOUBLE WHEN regexp_full_match(s, '-?\d+(\.\d+)?') THEN s::DOUBLE END"""
_NUMBERS = f"(SELECT *, {_NUMBER} AS value FROM (SELECT *, regexp_replace(cell, '[€$£\\s\\x{{a0}}]', '', 'g') AS s FROM {_CELLS}))"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "table_rows").select("row_id", "year", "data", F.explode("data").alias("name", "cell"))


@query(f"SELECT row_id, name, value FROM {_NUMBERS} WHERE value IS NOT NULL")
def numeric_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("row_id", "name", V.cell_number(F.col("cell")).alias("value")).where("value IS NOT NULL")


@query(r"""SELECT row_id, trim(regexp_replace(trim(name), '\s+', ' ', 'g'), ' :;,.|-') AS header, coalesce(cell, '') AS cell, min(row_id) OVER (PARTITION BY attachment_path, table_index, page, r) AS first_row
    FROM (SELECT row_id, attachment_path, table_index, page, array_to_string(list_sort(list_transform(map_entries(data), lambda e: concat(e.key, '=', coalesce(e.value, '')))), '|') AS r, unnest(map_entries(data)).key AS name, unnest(map_entries(data)).value AS cell FROM table_rows)""")
def flatten_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "table_rows").withColumn("r", F.array_join(F.array_sort(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "|"))
    first = F.min("row_id").over(Window.partitionBy("attachment_path", "table_index", "page", "r"))
    return rows.withColumn("first_row", first).select("row_id", "first_row", F.explode("data").alias("name", "cell")).select("row_id", T.normal_header(F.col("name")).alias("header"), F.coalesce("cell", F.lit("")).alias("cell"), "first_row")


_YEAR = r"""coalesce(nullif(regexp_extract(list_filter(map_entries(data), lambda e: regexp_matches(lower(e.key), 'year|år|ano'))[1].value, '(\d{4})', 1), '')::INT,
    nullif(regexp_extract(array_to_string(list_filter(map_values(data), lambda v: v IS NOT NULL), ' '), '((?:19|20)\d{2})', 1), '')::INT, year)"""


def _dated_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "table_rows").withColumn("year", V.row_year(F.col("data"), F.col("year")))
    return rows.select("message_id", "attachment_path", "page", "table_index", "row_index", "row_id", "year", F.explode("data").alias("name", "cell")).withColumn("value", V.cell_number(F.col("cell"))).where("value IS NOT NULL")


@query(f"SELECT row_id, year, trim(regexp_replace(trim(name), '\\s+', ' ', 'g'), ' :;,.|-') AS column_name, value FROM (SELECT row_id, year, name, {_NUMBER} AS value FROM (SELECT *, regexp_replace(cell, '[€$£\\s\\x{{a0}}]', '', 'g') AS s FROM (SELECT row_id, year, e.key AS name, e.value AS cell FROM (SELECT row_id, {_YEAR} AS year, unnest(map_entries(data)) AS e FROM table_rows)))) WHERE value IS NOT NULL")
def year_cells(spark: SparkSession, d: str) -> DataFrame:
    """Numeric cells with the year of their row, as the CSV of cells has them."""
    return _dated_cells(spark, d).select("row_id", "year", T.normal_header(F.col("name")).alias("column_name"), "value")


@query(f"""SELECT year, metric, round(sum(value), 4) AS total, count(*) AS cells FROM (SELECT year, value, unnest(list_filter(['price', 'qty', 'weight'], lambda m: contains(lower(name), m))) AS metric FROM
    (SELECT year, name, {_NUMBER} AS value FROM (SELECT *, regexp_replace(cell, '[€$£\\s\\x{{a0}}]', '', 'g') AS s FROM (SELECT year, e.key AS name, e.value AS cell FROM (SELECT {_YEAR} AS year, unnest(map_entries(data)) AS e FROM table_rows)))) WHERE value IS NOT NULL AND (year IS NULL OR year >= 2019)) GROUP BY ALL""")
def year_metric_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals per year of the row and metric since 2019; cells of unknown year are kept under no year."""
    cells = _dated_cells(spark, d).where("year IS NULL OR year >= 2019").select("year", F.lower("name").alias("name"), "value")
    metrics = F.filter(F.array(*map(F.lit, ("price", "qty", "weight"))), lambda m: F.col("name").contains(m))
    return cells.select("year", "value", F.explode(metrics).alias("metric")).groupBy("year", "metric").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("cells"))


_GRID = "(SELECT row_id, row_index, coalesce(message_id, '') AS m, coalesce(attachment_path, '') AS a, coalesce(table_index, -1) AS t, list_transform(map_values(data), lambda c: coalesce(c, '')) AS cells FROM table_rows)"


@query(f"""SELECT row_id, i::INT AS position, CASE WHEN empty THEN concat('col_', i) ELSE head[i] END AS header, coalesce(cells[i], '') AS cell FROM
    (SELECT *, len(list_filter(head, lambda c: trim(c) <> '')) = 0 AS empty, unnest(range(1, len(head) + 1)) AS i FROM (SELECT *, first_value(cells) OVER (PARTITION BY m, a, t ORDER BY row_index NULLS FIRST, row_id) AS head FROM {_GRID}))""")
def table_grid(spark: SparkSession, d: str) -> DataFrame:
    """Rows read as bare cells under the first row of their table: headers, generic ones where it is empty, rows cut or filled up to it."""
    cells = F.transform(F.map_values("data"), lambda c: F.coalesce(c, F.lit("")))
    rows = table(spark, d, "table_rows").select("row_id", "row_index", F.coalesce("message_id", F.lit("")).alias("m"), F.coalesce("attachment_path", F.lit("")).alias("a"), F.coalesce("table_index", F.lit(-1)).alias("t"), cells.alias("cells"))
    head = rows.groupBy("m", "a", "t").agg(F.min_by("cells", F.struct("row_index", "row_id")).alias("head"))
    met = rows.join(head, ["m", "a", "t"])
    zipped = F.arrays_zip(V.generic_headers(F.col("head")).alias("header"), V.fitted(F.col("cells"), F.size("head")).alias("cell"))
    return met.select("row_id", F.posexplode(zipped).alias("i", "x")).select("row_id", (F.col("i") + 1).alias("position"), F.col("x.header").alias("header"), F.col("x.cell").alias("cell"))


@query("""SELECT message_id, CASE WHEN length(t) > 1800 THEN concat(substr(t, 1, 1800), '…') ELSE t END AS context FROM (SELECT message_id, string_agg(text, E'\\n\\n' ORDER BY id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY id) AS n FROM chunks WHERE text IS NOT NULL) WHERE n <= 5 GROUP BY message_id)""")
def context_docs(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("message_id").orderBy("id"))
    first = table(spark, d, "chunks").where("text IS NOT NULL").withColumn("n", rank).where("n <= 5")
    joined = first.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("c"))
    return joined.select("message_id", T.shortened(F.array_join(F.transform("c", lambda x: x["text"]), "\n\n"), 1800).alias("context"))


_SUMMARY = r"""SELECT doc_id, pos, line, substr(regexp_replace(lower(line), '[^a-z0-9_]+', ' ', 'g'), 1, 120) AS k FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' -') AS line, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    WHERE raw LIKE '-%' OR raw LIKE '%.' OR length(raw) > 60"""


@query(f"SELECT doc_id, string_agg(concat('- ', line), chr(10) ORDER BY pos) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS n FROM ({_SUMMARY})) WHERE n = 1) WHERE r <= 12 GROUP BY doc_id")
def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve telling lines of each document, each once: bullets, sentences, long lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("raw"), F.btrim(x, F.lit(" -")).alias("line"))), lambda x: x["raw"].startswith("-") | x["raw"].endswith(".") | (F.length(x["raw"]) > 60))
    keyed = F.transform(lines, lambda x: F.struct(F.substring(F.regexp_replace(F.lower(x["line"]), "[^a-z0-9_]+", " "), 1, 120).alias("k"), x["pos"].alias("pos"), x["line"].alias("line")))
    told = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(keyed).alias("x")).groupBy("doc_id", "x.k").agg(F.min(F.struct("x.pos", "x.line")).alias("f"))
    each = told.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return each.select("doc_id", F.array_join(F.transform(F.slice("fs", 1, 12), lambda f: F.concat(F.lit("- "), f["line"])), "\n").alias("summary"))


@query("SELECT id, printf('[%d] %s — %s (%s)', id, coalesce(subject, ''), coalesce(from_email, ''), CASE WHEN date_ts BETWEEN 1 AND 4102444800 THEN strftime(to_timestamp(date_ts) AT TIME ZONE 'UTC', '%Y-%m-%d') ELSE '' END) AS citation FROM messages")
def source_citations(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("date_ts").between(1, 4102444800), F.date_format(F.timestamp_seconds("date_ts"), "yyyy-MM-dd")).otherwise("")
    return table(spark, d, "messages").select("id", F.format_string("[%d] %s — %s (%s)", "id", F.coalesce("subject", F.lit("")), F.coalesce("from_email", F.lit("")), day).alias("citation"))


@query("SELECT id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '…') ELSE text END AS snippet FROM chunks")
def snippet_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", T.shortened(F.col("text"), 200).alias("snippet"))


@query(r"""SELECT event_id, event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INT AS n_keys FROM events""")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    return table(spark, d, "events").select("event_id", "event_type", F.get(entries, 0)["value"].alias("first_value"), F.size(entries).alias("n_keys"))


@query(r"""SELECT id, unnest(regexp_extract_all(to_emails, '[^\s<>,;"]+@[^\s<>,;"]+')) AS address FROM messages""")
def address_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", F.explode(T.addresses(F.col("to_emails"))).alias("address"))


@query(f"""SELECT doc_id, concat(CASE WHEN s > 0 THEN '…' ELSE '' END, array_to_string(list_transform(ts[s + 1:s + 8], lambda x: CASE WHEN x IN ('pump', 'report') THEN concat('[', x, ']') ELSE x END), ' '), CASE WHEN len(ts) > s + 8 THEN '…' ELSE '' END) AS snippet
    FROM (SELECT *, greatest(least(least(list_position(ts, 'pump'), list_position(ts, 'report')) - 3, len(ts) - 8), 0) AS s FROM {_DOC_TERMS} WHERE list_contains(ts, 'pump') AND list_contains(ts, 'report'))""")
def fts_snippet(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = _documents(spark, d).search(QUESTION)
    return docs.join(hits, "doc_id").select("doc_id", T.snippet(F.col("text"), QUESTION).alias("snippet"))


@query()
def fts_snippet_each(spark: SparkSession, d: str) -> DataFrame:
    return _search_each(spark, d, "documents", "doc_id", snippet=8).select("query_id", "doc_id", "snippet")


@query(r"""SELECT id, d[1] AS from_day, d[2] AS to_day, 1.0::DOUBLE AS weight FROM (SELECT id, regexp_extract_all(headers_json, '\d{4}-\d{2}-\d{2}') AS d FROM messages) WHERE len(d) >= 2""")
def hypotheses_json(spark: SparkSession, d: str) -> DataFrame:
    """Date hypotheses read from JSON texts that name the days found in each message's headers."""
    days = F.regexp_extract_all("headers_json", F.lit(r"\d{4}-\d{2}-\d{2}"), 0)
    said = table(spark, d, "messages").select("id", days.alias("d")).where("size(d) >= 2")
    json = F.to_json(F.struct(F.array(F.struct(F.concat(F.get("d", 0), F.lit("T00:00")).alias("from_date"), F.get("d", 1).alias("to"))).alias("temporal_hypotheses")))
    read = said.select("id", F.explode(T.hypotheses(F.concat(F.lit("Sure: "), json, F.lit(" ok")))).alias("h"))
    return read.select("id", F.col("h.from").alias("from_day"), F.col("h.to").alias("to_day"), "h.weight")


@query(r"SELECT parse_id, unnest(list_distinct(regexp_extract_all(body, '\d{4}-\d{2}-\d{2}'))) AS day FROM parsed_messages")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_messages").select("parse_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\d{4}-\d{2}-\d{2}"), 0))).alias("day"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month_start, last_day(o_orderdate::DATE)::VARCHAR AS month_end, date_trunc('year', o_orderdate)::DATE::VARCHAR AS year_start FROM orders")
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", *(c.cast("string").alias(n) for c, n in ((F.trunc(day, "month"), "month_start"), (F.last_day(day), "month_end"), (F.trunc(day, "year"), "year_start"))))


@query("SELECT path_text, CASE WHEN pages > 0 THEN length(text) / pages < 120 ELSE length(text) < 240 END AS needs_ocr FROM attachment_text")
def ocr_decision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attachment_text").select("path_text", V.needs_ocr(F.length("text"), F.col("pages")).alias("needs_ocr"))


@query("SELECT lower(from_email) AS sender, count(*) AS mails, count(DISTINCT folder) AS folders FROM messages WHERE from_email IS NOT NULL GROUP BY 1")
def sender_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("from_email IS NOT NULL").groupBy(F.lower("from_email").alias("sender")).agg(F.count("*").alias("mails"), F.countDistinct("folder").alias("folders"))


@query("SELECT c.id, t.text FROM attachments c JOIN attachment_text t ON t.path_text = c.path_text")
def attachment_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attachments").select("id", "path_text").join(table(spark, d, "attachment_text").select("path_text", "text"), "path_text").select("id", "text")


@query("SELECT message_id FROM parsed_messages WHERE message_id IS NOT NULL GROUP BY message_id")
def stream_ingest_available_now(spark: SparkSession, d: str) -> DataFrame:
    out = shared_folder(spark, "ingest")
    source = stream.parquet_stream(spark, f"{d}/parsed_messages.parquet")
    stream.ingest(spark, source, f"{out}/table", f"{out}/state", "message_id", ["scanned_at", "path", "parse_id"]).awaitTermination()
    return spark.read.parquet(f"{out}/table").select("message_id")
