"""Text statistics per document, their place in their language's distribution, and a text class.

Every statistic of a document, the shares of its characters in lines shaped like prose, a list, a
table or junk among them, is set against a mergeable quantile sketch of that statistic over the
different texts of its language, as a percentile and a robust z-score. A document whose prose lies in
the low tail of its language is no prose; its class is the kind of line that is furthest out in the
high tail.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the archive's languages (fixed values).
COMMON = frozenset(
    "the a an of to in on at for and or is are was were be been has have it that this with as by we you not no from will if but so our".split()
    + "der die das des dem den ein eine einen und oder ist sind wird wurde wir sie nicht mit von für im zu auf an bei noch aus am".split()
    + "le la les un une des du de et est sont a été pour dans au aux que qui pas ne sur avec par ce cette en après".split()
    + "el los las del y es con por se al más una su hasta este esta todavía según".split()
    + "o os as um uma do da dos das e foi não na no nas ao à com após está até em".split()
    + "и в на не с по для что это как за от до был была будет из к о у же без всех пока".split()
)
STATS = ["n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "words_per_line", "distinct_words"]
CLASSES = ["list", "table", "junk"]
SHARES = ["prose", *CLASSES]
MEASURED = [*STATS, *SHARES]
#: Robust z-score of the prose share from which on a text lies in the low tail.
TAIL = 4.0
#: Least spread of a statistic, in shares of what it can span, so that z-scores stay finite where texts agree.
LEAST_SPREAD = 0.125
#: A language has sketches of its own with so many different texts and this share of all; there are at most 1 / share.
LEAST_TEXTS, LEAST_SHARE = 50, 1e-3
#: Steps of the quantile grid that percentiles are read from.
STEPS = 40

_BULLET = re.compile(r"(?:[-*+•▪◦‣·–—●■□☐☑✓»→] |\[[ xX]?\] |\(?(?:\d{1,4}|[a-zA-Zа-яА-Я]|[ivxIVX]{1,5})(?:[.)]| -)(?:\d+[.)]?)* |\d{1,2}:\d{2} |https?://|www\.)")
_LOG = re.compile(r"^(?:[A-Z][\w]*-[A-Z][\w-]*: ?|--=?_)|(?:=[0-9A-F]{2}){2}|\w+\[\d+\]:|\bcode=\d+|^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S* (?:[A-Z]{3,}|\[)")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|[{};]\s*$|^\s*[.#@]?[\w-]+\s*\{|&[a-z]+;")
_NUMBER = re.compile(r"[-+~(]?[€$£]?\d[\d.,'\u00a0 ]*%?\)?")
_CELL_GAP = re.compile(r" {2,}|\t| ?[|;] ?")
_END = frozenset(".!?…:,;")
_MIXED = re.compile(r"(?=\w*\d)(?=\w*[^\W\d_])\w{2,}")


def _kinds_of_characters() -> np.ndarray:
    """For each code point up to U+2FFF: 1 letter, 2 digit, 4 white space, 0 symbol."""
    return np.array([1 if c.isalpha() or unicodedata.category(c)[0] == "M" else 2 if c.isdigit() else 4 if c.isspace() else 0 for c in map(chr, range(0x3000))], dtype=np.uint8)


_KIND = _kinds_of_characters()


def _line_kind(line: str, words: list[str], common: int) -> str:
    """Class of one line by its shape: prose, list, table, junk, rule, cell, short or number."""
    n, bare = len(words), line.strip()
    while bare[:1] == ">":
        bare = bare[1:].lstrip()
    if not bare:
        return "rule"
    bullet = _BULLET.match(bare)
    if n >= 7 and common >= 2 and not bullet:
        return "prose"
    size = len(bare)
    alnum = sum(map(str.isalnum, bare))
    if alnum < 0.3 * (size - bare.count(" ")):
        return "rule" if len(set(bare)) <= 4 else "junk"
    cells = [c for c in _CELL_GAP.split(bare) if c]
    if "|" in bare or "\t" in bare:
        if bare.count("|") >= 2 and bare[0] != "|" and not any(_NUMBER.fullmatch(c) for c in cells):
            return "nav"
        if bare.count("|") >= 2 or "\t" in bare:
            return "table"
    if _LOG.search(bare) or "<" in bare and _MARKUP.search(bare) or "{" in bare:
        return "junk"
    if len(cells) >= 3 and sum(len(c.split()) for c in cells) <= 2.5 * len(cells):
        return "table"
    if bare.count(",") >= 2 and n <= bare.count(",") + 1 and n <= 3:
        return "table"
    if size > 24 and n <= size / 24:
        return "list" if "://" in bare and n <= 3 else "junk"
    if n >= 4 and 2 * sum(1 for w in words if _MIXED.fullmatch(w)) > n:
        return "junk"
    if n <= 2 and _NUMBER.fullmatch(bare) or bare in ("-", "n/a", "–"):
        return "number"
    if bullet:
        return "list"
    if n >= 20:
        kinds = len({w.strip(",.") for w in words})
        return "junk" if kinds < 0.5 * n and common < 3 else "prose" if common >= 2 else "junk"
    if n >= 10 and common or bare[-1] in ".!?…" and n >= 3:
        return "prose"
    return "cell" if n == 1 else "short"


def text_statistics(text: str | None) -> tuple:
    """MEASURED of one text; an empty one has zeros and counts as prose."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return (0,) + (0.0,) * 7 + (1.0,) + (0.0,) * 3
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = _KIND[np.minimum(codes, 0x2FFF)]
    letter = of == 1
    letters, digits, symbols = int(letter.sum()), int((of == 2).sum()), int((of == 0).sum())
    n_words = int(letter[0]) + int((letter[1:] & ~letter[:-1]).sum())
    tokens = [x.lower().split() for x in lines]
    commons = [len(COMMON.intersection(t)) for t in tokens]
    kinds = [_line_kind(*x) for x in zip(lines, tokens, commons, strict=True)]
    n_tokens = sum(map(len, tokens))
    sums = _shares(lines, tokens, kinds)
    total = max(1, sum(sums.values()) - sums["rule"])
    return (
        n_words, letters / max(1, n_words), symbols / len(text), digits / len(text),
        sum(1 for x in lines if x.rstrip()[-1] in _END) / len(lines), sum(commons) / n_tokens,
        n_tokens / len(lines), len(set().union(*tokens)) / n_tokens,
        sums["prose"] / total if sums["prose"] or total > 1 else 1.0, sums["list"] / total, sums["table"] / total, sums["junk"] / total,
    )


def _shares(lines: list[str], tokens: list[list[str]], kinds: list[str]) -> dict[str, int]:
    """Characters per class, the lines that depend on their neighbours settled."""
    sums = dict.fromkeys(("prose", "list", "table", "junk", "rule"), 0)
    numbers, n_cells = kinds.count("number"), kinds.count("number") + kinds.count("cell")
    column = n_cells >= 8 and numbers >= 0.15 * n_cells
    nav = "table" if kinds.count("table") > kinds.count("nav") else "junk"
    shorts = [len(t) for t, k in zip(tokens, kinds, strict=True) if k == "short"]
    run_words = sum(shorts) / max(1, len(shorts))
    previous = ""
    for i, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
        if kind == "nav":
            kind = nav
        elif kind in ("cell", "number"):
            kind = "table" if column else "prose" if previous == "prose" or kind == "cell" and line.rstrip()[-1] in ",.!:" else "list"
        elif kind == "short":
            # Lines of a few words are list items, but a wrapped paragraph's last line follows prose.
            bare = line.strip()
            following = kinds[i + 1] if i + 1 < len(kinds) else ""
            wrapped = previous == "prose" and (len(lines[i - 1]) > 40 and lines[i - 1].rstrip()[-1] not in ".!?:" or line[0] == ">" or lines[i - 1][0] == ">")
            greeting = bare[-1] in ",!:" and len(bare) < 40
            kind = "prose" if wrapped or greeting or (following == "prose" and len(shorts) <= 3) or (run_words > 5.8 and ": " not in bare) else "list"
        elif kind == "rule":
            kind = previous if previous in ("table", "junk") else "rule"
        sums[kind] += len(line)
        previous = kind
    return sums


def document_statistics(df: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """doc_id, lang (lower case, ``und`` if unknown), text_key (hash of the text) and MEASURED, per row.

    Null, empty and blank texts have zeros and a prose share of 1. Whole texts are read, whatever
    their length.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            stats = pd.DataFrame([text_statistics(t) for t in rows["text"]], columns=MEASURED)
            yield pd.concat([rows[["doc_id", "lang", "text_key"]].reset_index(drop=True), stats], axis=1)

    known = F.lower(F.trim(lang))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.when(known != "", known), F.lit("und")).alias("lang"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    schema = "doc_id long, lang string, text_key long, n_words long, " + ", ".join(f"{c} double" for c in MEASURED[1:])
    return rows.mapInPandas(measure, schema)


def language_sketches(stats: DataFrame) -> DataFrame:
    """One row per language and one (lang null) for all: a mergeable quantile sketch of each statistic over the different texts.

    Copies of a text count once. Partial sketches are built where the rows are and merged, so a
    language with most of the documents costs no more shuffle than a rare one.
    """
    different = stats.dropDuplicates(["lang", "text_key"])
    return different.rollup("lang").agg(F.count("*").alias("texts"), *(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(200)).alias(c) for c in MEASURED))


def standardise(stats: DataFrame, sketches: DataFrame) -> DataFrame:
    """``stats`` with p_<statistic> (share of the language's texts below) and z_<statistic>.

    z is the distance from the median in units of a normal distribution's quartile distance, taken on
    the side that is tighter, as the other may hold a tail, and at least ``LEAST_SPREAD`` of what the
    statistic spans among all texts. Languages of too few texts, or
    where prose is not the usual, are measured by all languages together. An empty table gives none.
    """
    at = F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1)))
    grids = sketches.select("lang", "texts", *(F.kll_sketch_get_quantile_double(c, at).alias(f"q_{c}") for c in MEASURED))
    every = grids.where("lang IS NULL").first()
    if every is None or not every["texts"]:
        return stats.select(*stats.columns, *(F.lit(0.0).alias(f"{k}_{c}") for k in "pz" for c in MEASURED)).limit(0)
    own = grids.where((F.col("texts") >= max(LEAST_TEXTS, LEAST_SHARE * every["texts"])) & (F.get("q_prose", STEPS // 2) > 0.5)).drop("texts").where("lang IS NOT NULL")
    df = stats.join(F.broadcast(own), "lang", "left")
    for c in MEASURED:
        df = df.withColumn(f"q_{c}", F.coalesce(f"q_{c}", F.array(*map(F.lit, every[f"q_{c}"]))))

    def percentile(c: str):
        return (F.size(F.filter(f"q_{c}", lambda q: q < F.col(c))) / (STEPS + 1)).alias(f"p_{c}")

    def z(c: str):
        low, mid, high = (F.get(F.col(f"q_{c}"), STEPS * k // 4) for k in (1, 2, 3))
        span = 1.0 if c in SHARES else max(every[f"q_{c}"][-2] - every[f"q_{c}"][1], 1e-9)
        return ((F.col(c) - mid) / F.greatest(F.least(high - mid, mid - low) / 0.6745, F.lit(LEAST_SPREAD * span))).alias(f"z_{c}")

    return df.select(*stats.columns, *map(percentile, MEASURED), *map(z, MEASURED))


def classify(scored: DataFrame) -> DataFrame:
    """Adds text_class: prose, or where the prose share lies in the low tail, the class that is furthest out in the high one."""
    kinds = F.array_sort(F.array(*(F.struct((-F.col(f"z_{c}")).alias("out"), F.lit(c).alias("kind")) for c in CLASSES)))
    return scored.withColumn("text_class", F.when(F.col("z_prose") < -TAIL, F.get(kinds, 0)["kind"]).otherwise("prose"))
