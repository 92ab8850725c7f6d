"""Text functions as column expressions: analyzer, query terms, HTML, paragraphs, snippets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make up a term: letters, digits, private use, and . _ - @ (fixed values).
TERM = r"[\p{L}\p{N}\p{Co}._@-]+"
QUERY_TERM = r"[\p{L}\p{N}_@.-]+"
#: The entities that are decoded by name; numbered ones are decoded by code point.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def _marked() -> tuple[str, str]:
    """Letters with diacritics, by their Unicode decomposition, and the letters without."""
    folded = {c: base[0] for c in map(chr, (*range(0xC0, 0x530), *range(0x1E00, 0x2000))) if c.islower() and len(base := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.category(x) == "Mn" for x in base[1:])}
    return "".join(folded), "".join(folded.values())


_MARKED = _marked()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), *_MARKED)


def terms(text: Column) -> Column:
    """Lower-cased terms of a text in order, without diacritics; null text has none."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def query_terms(question: Column) -> Column:
    """Terms of a question that full-text search requires: lower case, two characters or more."""
    return F.filter(F.coalesce(F.regexp_extract_all(folded(question), F.lit(QUERY_TERM), F.lit(0)), F.array().cast("array<string>")), lambda t: F.length(t) >= 2)


def match_expression(question: Column) -> Column:
    """The question as a full-text expression: its terms joined by AND."""
    return F.array_join(query_terms(question), " AND ")


def html_to_text(html: Column) -> Column:
    """Visible text of HTML on one line: scripts and styles dropped, tags blanked, entities decoded."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"), r"(?i)</p\s*>", "\n\n")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for name, char in ENTITIES.items():
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[ \t\r\n\f\u000b ]+", " "))


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs of a text, trimmed; a blank line or more parts them."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.regexp_replace(p, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", ""))
    return F.filter(parts, lambda p: p != "")


def chunks(text: Column, target: int = 800) -> Column:
    """Paragraphs gathered into chunks of about ``target`` characters; a paragraph is never cut.

    A chunk is closed before the paragraph that would carry it past the target; each paragraph
    weighs two characters more than its length. A text of white space alone gives no chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).cast("int").alias("size"))

    def add(state: Column, p: Column) -> Column:
        full = state["open"].isNotNull() & (state["size"] + F.length(p) > target)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full | state["open"].isNull(), p).otherwise(F.concat(state["open"], F.lit("\n\n"), p)).alias("open"),
            (F.when(full, 0).otherwise(state["size"]) + F.length(p) + 2).cast("int").alias("size"),
        )

    return F.aggregate(paragraphs(text), start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def shortened(text: Column, limit: int) -> Column:
    """First ``limit`` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def normal_header(name: Column) -> Column:
    """A table header without repeated white space or punctuation at its ends."""
    return F.btrim(F.regexp_replace(F.trim(name), r"\s+", " "), F.lit(" :;,.|-"))


def meta_text(names: Column, body: Column) -> Column:
    """What a message is about on a few lines: its headers, the names of its attachments, the beginning of its body."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in (("SUBJECT", F.col("subject")), ("FROM", F.col("from_email")), ("TO", F.col("to_emails")), ("CC", F.col("cc_emails")), ("FOLDER", F.col("folder")), ("ATTACHMENTS", names))]
    return F.concat_ws("\n", *lines, F.when(body != "", F.concat(F.lit("BODY: "), F.substring(body, 1, 500))))


def addresses(header: Column) -> Column:
    """Mail addresses in a header's text, in order."""
    return F.coalesce(F.regexp_extract_all(header, F.lit(r'[^\s<>,;"]+@[^\s<>,;"]+'), F.lit(0)), F.array().cast("array<string>"))


def snippet(text: Column, wanted: list[str] | Column, width: int = 8) -> Column:
    """``width`` terms of a text from shortly before its first wanted one, matches in brackets.

    A text without a match gives its first terms; terms left out at either end show as an ellipsis.
    """
    hit = wanted if isinstance(wanted, Column) else F.array(*map(F.lit, wanted))
    every = terms(text)
    first = F.coalesce(F.get(F.filter(F.transform(every, lambda t, i: F.when(F.array_contains(hit, t), i)), lambda i: i.isNotNull()), 0), F.lit(0))
    start = F.greatest(F.least(first - 2, F.size(every) - width), F.lit(0))
    shown = F.transform(F.slice(every, start + 1, F.lit(width)), lambda t: F.when(F.array_contains(hit, t), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(F.size(every) > start + width, "…").otherwise(""))


def hypotheses(json: Column) -> Column:
    """Date hypotheses of a JSON text: array of struct(from, to, weight).

    The text may hold other words around its object. Bounds may be named ``from`` or ``from_date``
    and ``to`` or ``to_date``; both are required, times are cut off, the weight defaults to 1.
    """
    item = "struct<`from`:string,from_date:string,`to`:string,to_date:string,weight:double>"
    body = F.regexp_extract(json, r"(?s)\{.*\}", 0)
    read = F.from_json(body, f"struct<temporal_hypotheses:array<{item}>,`from`:string,from_date:string,`to`:string,to_date:string,weight:double>")
    top = F.array(F.struct(*(read[c].alias(c) for c in ("from", "from_date", "to", "to_date", "weight"))))
    day = lambda c: F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1)
    each = F.transform(
        F.coalesce(read["temporal_hypotheses"], top),
        lambda h: F.struct(day(F.coalesce(h["from"], h["from_date"])).alias("from"), day(F.coalesce(h["to"], h["to_date"])).alias("to"), F.coalesce(h["weight"], F.lit(1.0)).alias("weight")),
    )
    return F.filter(each, lambda h: (h["from"] != "") & (h["to"] != ""))
