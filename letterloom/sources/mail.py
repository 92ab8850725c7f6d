"""Mail files as DataFrames: Maildir folders, mbox files and .emlx files.

Spark lists, splits and reads the files; one small function parses a single message.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from datetime import UTC
from email import message_from_bytes, policy
from email.message import EmailMessage
from email.utils import getaddresses, parsedate_to_datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = (
    "message_id string, subject string, from_email string, to_emails string, cc_emails string, date_ts long, in_reply_to string, has_attachments boolean, headers_json string, body string, "
    "attachments array<struct<filename:string,mime:string,sha256:string,bytes:long,content:binary>>"
)


#: Kinds of files by their extension (fixed values).
MIME = {"pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "doc": "application/msword", "xls": "application/vnd.ms-excel", "zip": "application/zip"}


def _addresses(message: EmailMessage, name: str) -> str:
    return ", ".join(a for _, a in getaddresses([str(v) for v in message.get_all(name, [])]) if a)


def _date(message: EmailMessage) -> int:
    try:
        at = parsedate_to_datetime(str(message["date"]))
        return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())
    except (TypeError, ValueError):
        return 0


def _body(message: EmailMessage) -> str:
    plain, hyper = [], []
    for part in message.walk():
        if part.is_multipart() or part.get_filename() or part.get_content_disposition() == "attachment":
            continue
        if part.get_content_type() in ("text/plain", "text/html"):
            try:
                (plain if part.get_content_type() == "text/plain" else hyper).append(part.get_content())
            except (LookupError, UnicodeError):
                (plain if part.get_content_type() == "text/plain" else hyper).append((part.get_payload(decode=True) or b"").decode("utf-8", "replace"))
    if plain or not hyper:
        return "\n".join(plain)
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", "\n".join(hyper))
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", text))).strip()


def parse(raw: bytes) -> dict:
    """One message's columns. Broken parts are left out; a message without an id gets one from its content."""
    message = message_from_bytes(raw, policy=policy.default)
    files = []
    for part in message.walk():
        name = part.get_filename()
        if part.is_multipart() or not (name or part.get_content_disposition() == "attachment"):
            continue
        content = part.get_payload(decode=True) or b""
        if content:
            kind = part.get_content_type()
            files.append({"filename": name or "part." + kind.replace("/", "."), "mime": kind, "sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content), "content": content})
    try:
        body = _body(message)
    except Exception:  # a body no decoder can read
        body = ""
    sender, to, date = _addresses(message, "from"), _addresses(message, "to"), _date(message)
    subject = re.sub(r"\s+", " ", str(message["subject"] or "")).strip()
    own = "synthetic-" + hashlib.sha256("|".join((subject, sender, to, str(date), hashlib.sha256(body.encode("utf-8", "replace")).hexdigest())).encode("utf-8", "replace")).hexdigest()
    return {
        "message_id": str(message["message-id"] or "").strip() or own,
        "subject": subject, "from_email": sender, "to_emails": to, "cc_emails": _addresses(message, "cc"), "date_ts": date,
        "in_reply_to": str(message["in-reply-to"] or "").strip(), "has_attachments": bool(files),
        "headers_json": json.dumps({k: str(v) for k, v in message.items()}, ensure_ascii=False), "body": body, "attachments": files,
    }


def parsed(raw: DataFrame) -> DataFrame:
    """``raw`` (path, account, folder, raw binary) as messages; an unreadable message gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, account, folder, content in zip(rows["path"], rows["account"], rows["folder"], rows["raw"], strict=True):
                try:
                    out.append({"path": path, "account": account, "folder": folder, **parse(bytes(content))})
                except Exception:  # one bad file must not stop the scan
                    continue
            names = ["path", "account", "folder", *(c.strip().split(" ")[0] for c in MESSAGE.split(", "))]
            yield pd.DataFrame(out, columns=names)

    return raw.select("path", "account", "folder", "raw").mapInPandas(run, "path string, account string, folder string, " + MESSAGE)


def _below(root: str, path: Column) -> Column:
    """The part of ``path`` under ``root``."""
    return F.element_at(F.split(path, re.escape(root.rstrip("/").removeprefix("file:")) + "/"), -1)


def read_maildir(spark: SparkSession, root: str, account: str = "") -> DataFrame:
    """Messages of every ``cur`` and ``new`` folder below ``root``; the folder is the path above them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.col("path").rlike(r"/(?:cur|new)/[^/]+$"))
    folder = F.regexp_replace(_below(root, F.col("path")), r"/?(?:cur|new)/[^/]+$", "")
    return parsed(files.select("path", F.lit(account).alias("account"), folder.alias("folder"), F.col("content").alias("raw")))


def read_mbox(spark: SparkSession, path: str, account: str = "", folder: str | None = None) -> DataFrame:
    """Messages of mbox files, cut at their ``From `` lines by Spark's own splitting of large files.

    A record's bytes are kept as they are, whatever their encoding; only its first line is dropped.
    """
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    raw = lines.where(F.length(F.trim("value")) > 0).select("path", F.lit(account).alias("account"), F.coalesce(F.lit(folder), F.concat(F.lit("mbox/"), F.regexp_replace("name", r"\.[^.]*$", ""))).alias("folder"), F.col("value").cast("binary").alias("raw"))

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(raw=[bytes(c).partition(b"\n")[2] for c in rows["raw"]])

    return parsed(raw.mapInPandas(body, "path string, account string, folder string, raw binary"))


def emlx_bytes(content: bytes) -> bytes:
    """The message in an .emlx file: the first line gives its length; without one the whole file is it."""
    first, _, rest = content.partition(b"\n")
    return rest[: int(first)] if first.strip().isdigit() else content


def sidecar_files(spark: SparkSession, root: str) -> DataFrame:
    """(mailbox, stem, filename, mime, sha256, bytes, content) of files kept beside .emlx messages under ``Attachments/<stem>/``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(r"/Attachments/[^/]+/") & (F.col("length") > 0))
    parts = F.regexp_extract("path", r"^(.*?)(?:/Messages)?/Attachments/([^/]+)/(?:.*/)?([^/]+)$", 1)
    kind = F.element_at(F.split(F.lower("path"), r"\."), -1)
    mime = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), MIME.items(), F.when(F.lit(False), "")).otherwise("application/octet-stream")
    return files.select(parts.alias("mailbox"), F.regexp_extract("path", r"/Attachments/([^/]+)/", 1).alias("stem"), F.element_at(F.split("path", "/"), -1).alias("filename"), mime.alias("mime"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")


def with_sidecars(messages: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``messages`` of .emlx files with the files kept beside them added to their attachments, each content once.

    The join is by mailbox folder and the number that message and folder are named after; contents are
    gathered per message only, as many as one mail has.
    """
    own = messages.withColumn("mailbox", F.regexp_replace("path", r"(?:/Messages)?/[^/]+$", "")).withColumn("stem", F.regexp_extract("path", r"/([^/.]+)[^/]*$", 1))
    beside = sidecars.groupBy("mailbox", "stem").agg(F.array_sort(F.collect_list(F.struct("filename", "mime", "sha256", "bytes", "content"))).alias("beside"))
    met = own.join(beside, ["mailbox", "stem"], "left")
    every = F.concat(F.coalesce("attachments", F.array().cast(messages.schema["attachments"].dataType)), F.coalesce("beside", F.array().cast(messages.schema["attachments"].dataType)))
    first = F.filter(F.transform(every, lambda a, i: F.struct(a.alias("a"), (F.array_position(F.transform(every, lambda x: x["sha256"]), a["sha256"]) == i + 1).alias("first"))), lambda x: x["first"])
    kept = F.transform(first, lambda x: x["a"])
    return met.withColumn("attachments", kept).withColumn("has_attachments", F.size(kept) > 0).select(*messages.columns)


def read_emlx(spark: SparkSession, root: str, account: str = "", folder_filter: str | None = None) -> DataFrame:
    """Messages of the .emlx files below ``root``; ``folder_filter`` keeps folders that contain it, without case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.emlx").load(root)
    folder = F.regexp_replace(F.regexp_replace(_below(root, F.col("path")), r"/?[^/]+$", ""), r"/?Messages$", "")
    files = files.select("path", F.lit(account).alias("account"), folder.alias("folder"), "content")
    if folder_filter:
        files = files.where(F.lower("folder").contains(folder_filter.lower()))

    def unframe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(raw=[emlx_bytes(bytes(c)) for c in rows["content"]]).drop(columns="content")

    return parsed(files.mapInPandas(unframe, "path string, account string, folder string, raw binary"))
