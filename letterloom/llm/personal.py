"""Finding personal information in free text and replacing it with typed placeholders.

Bootstrapped contextual extraction. Seed entities (the names and addresses in mail headers, the cue
words around phone and identity numbers, words for streets) induce patterns: the words before a
mention, the shape of the digits, the signs that join the parts of a mail address, the words a street's
name is made with and the form of the postcode. Spark counts the pattern-instance graph over all texts
in one pass and scores it back and forth; instances that keep to trusted patterns, and patterns that
keep to trusted instances, become trusted themselves and so discover what no seed had. Workers get the
trusted names as sorted hashes of 64 bits, so one name never stands in for another, and short lists of
patterns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.encoding import _candidates
from letterloom.session import cut

ROUNDS = 2
#: Flags of a hashed word.
FIRST, LAST, CLEAR, LEFT = 1, 2, 4, 8

#: Seed cues of number types (fixed values): words right before or shortly before the number.
CUES = {
    "PHONE": "tel|tel.|tel:|telephone|phone|phone:|t:|m:|mobile|cell|fax|telefon|téléphone|teléfono|telefone|тел.|телефон|ring|unter|au|number",
    "ID_NUMBER": "passport|personal|personnummer|ssn|nif|dni|identité|documento|contribuinte|ausweisnummer|steuernummer|паспорта|tax|id",
    "OTHER": "order|invoice|lot|version|ticket|meeting|tracking|code|po|ref|ref.|nr.|no|№|page|paid",
}
#: Seed words for streets (fixed values): the last word, the first one, or with a hyphen the end of the only one.
STREETS = frozenset("street st road rd avenue ave lane ln court square drive dr parkway rue boulevard calle c/ avenida rua улица ул -aße -str -weg".split())
#: Signs that join a mail address (fixed seed): the plain ones.
JOINTS = "@|."
#: Least share of a pattern's mentions that must be known, and of all number mentions that a shape must have.
INDUCED, SHAPE_SHARE = 0.05, 1e-6
#: Given names that are everyday words or months as well (fixed values): alone they need a context.
_EVERYDAY = frozenset("may mark will rose bill grace hope joy faith dawn june april august sue pat drew art frank rob jack ray guy lance chase miles summer amber ivy lily pearl ruby olive".split())
_COMPANY = frozenset("ltd limited foods shipping pumps energi energy logistics group gmbh ag inc llc plc sa srl holding partners sons co corp company bank media systems works industries".split())
_STREET = frozenset("street st road rd ave avenue lane ln court ct square sq drive dr way close place terrace boulevard blvd".split())
_THINGS = _COMPANY | _STREET
_TITLE = frozenset("mr mrs ms miss dr prof herr frau mme mlle sr sra señor señora senhor senhora monsieur madame г-н г-жа".split())

_BREAK = re.compile(r"\n(?:[ \t>»|:]|[A-Z]{1,3}>)*(?:\r?\n(?:[ \t>»|:]|[A-Z]{1,3}>)*)*")
_MARKED = re.compile(r"\n(?:[ \t>»|:\r]|[A-Z]{1,3}>)")
_S = r"[  \x02]"
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_LOCAL = re.compile(r"[\w.+%-]*")
_BRACKETED = re.compile(r"[\[(]\w{2,8}[\])]")
_SPELLED = re.compile(r" ?([\w-]+)((?: ?[\[(]\w{2,8}[\])] ?[\w-]+|\.[\w-]+)+)")
_POINT = re.compile(r" ?[\[(](\w{2,8})[\])] ?")
_DIGITS = re.compile(r"\d[\d()  \x02./-]{4,}")
_DATE = re.compile(r"(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./](?:\d{4}|\d{2})(?!\d))")
_GROUP = rf"(?:\(\d{{1,5}}\)|\d+)"
_NUMBER = re.compile(rf"(?<![\w@./:€£$#-])(?:\+\(?|[A-Z]{{2,3}}(?=\d)|)(?:{_GROUP}(?:(?:[.\-/]|{_S}{{1,6}}|(?<=\)))(?=[\d(])){{1}})*\d+(?:-?[A-Z](?![\w-])|)(?:{_S}(?:ext|x)\.?{_S}?\d{{1,5}})?(?![\w@])", re.ASCII)
_TOWN = r"[^\W\d_a-zà-ÿ][\w'’\x80-ɏ-]*"
_POST = rf"(?:[A-Z]{{1,2}}\d[A-Z\d]?{_S}+\d[A-Z]{{2}}|(?:[A-Z]{{2}}{_S}+)?\d{{5}}(?:-\d{{4}})?)"
#: Begins with a digit, which is searched for fast; letters before it are looked at afterwards.
_POSTCODES = re.compile(r"[0-9](?:(?<![\w-][0-9])[0-9]{4}(?![0-9])|(?<=[A-Z][0-9])[A-Z0-9]?[  \x02]+[0-9][A-Z]{2}\b)")
_WORD = r"[^\W\d_a-zà-ÿ][^\s,;|<>]*"
#: How far around its postcode an address may reach.
_BEFORE, _AFTER = 160, 64
_ADDRESS = re.compile(
    rf"(?<!\w)(?:(?:Unit{_S}+\d+[A-Za-z]?,{_S}+)?\d{{1,5}}[A-Za-z]?,?{_S}+(?:{_WORD}{_S}+){{1,3}}?(?P<last>[^\W\d_a-zà-ÿ][^\W\d_]*)\.?,?{_S}+{_TOWN}(?:{_S}{_TOWN})?,?{_S}+{_POST}"
    rf"|\d{{1,5}}[A-Za-z]?,?{_S}+(?P<type>[^\W\d_]{{3,}}){_S}+(?:(?:de{_S}+la|du|des|de|d['’]){_S}*)?{_WORD},{_S}+{_POST}{_S}+{_TOWN}"
    rf"|(?P<first>[^\W\d_a-zà-ÿа-я][^\W\d_]*[./]?|[^\W\d_]{{2,4}}\.|[а-я]{{3,}}){_S}+(?:{_WORD}{_S}+){{0,3}}?{_WORD}{_S}*,?{_S}+\d{{1,4}}[a-z]?(?:,{_S}+\d{{1,2}}\S{{1,4}})?,{_S}+{_POST}{_S}+{_TOWN}"
    rf"|[^\W\d_a-zà-ÿ][\w-]*?(?P<end>[^\W\d_]{{2,3}})\.?{_S}+\d{{1,4}}{_S}?[a-z]?,{_S}+{_POST}{_S}+{_TOWN})"
)
#: Starts with a set of characters, which is searched for fast; what stands before is looked at afterwards.
_POST_FORM = re.compile(r"[A-Z]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞŁŃŘŚŠŹŻŽĀČĐĒĘĚĞĢĪĮİĶĻŅŌŐŠŤŪŮŰŲΑ-ΩЀ-Я](?<![\w@.].)[^\W\d_](?:[^\s,.;:!?()<>|\"“”@\x01\x02]|\.(?=\w))*")
_INITIAL_BEFORE = re.compile(rf"(?<!\w)([^\W\d_a-zà-ÿ]\.){_S}+$")
_MIDDLE = re.compile(rf"{_S}{{1,4}}[^\W\d_a-zà-ÿ]\.{_S}{{1,4}}")
_GAPS = str.maketrans("\x01\x02>|", "    ")
_ADJACENT = re.compile(r"[  ]{1,2}|\x02[  ]{0,8}")


def name_hash(word: str) -> int:
    """Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


_MASK = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, "\x02": " ", "\n": " ", "\xa0": " "})


def shape(number: str) -> str:
    """The number with digits as 9, letters as A, gaps as one space, without an extension."""
    s = number.partition("ext")[0].translate(_MASK)
    return (" ".join(s.split()) if "  " in s else s).strip()


def header_names(messages: DataFrame) -> DataFrame:
    """(word, is_first, is_last) of the display names in From headers."""
    raw = F.get(F.filter(F.map_entries(F.from_json("headers_json", "map<string,string>")), lambda e: F.lower(e["key"]) == "from"), 0)["value"]
    words = messages.select(F.split(F.trim(F.regexp_extract(raw, r'^"?([^<"@]+?)"?\s*<', 1)), r"\s+").alias("w")).where("size(w) >= 2 AND size(w) <= 4")
    each = words.select(F.get("w", 0).alias("word"), F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(words.select(F.element_at("w", -1).alias("word"), F.lit(0).alias("f"), F.lit(1).alias("l")))
    return each.where(F.col("word").rlike(r"^\p{Lu}\p{Ll}+")).groupBy("word").agg(F.max("f").alias("is_first"), F.max("l").alias("is_last"))


def evidence(texts: DataFrame) -> DataFrame:
    """(kind, a, b, c, n): what all texts say about names, numbers, mail addresses and postal ones, in one pass.

    ``name``: the word before in lower case, as written, and the capitalised word. ``number``: shape and
    cue word. ``mail``: joining signs and address. ``place``: word of a street and form of the postcode.
    Counts are combined per task before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, str, str, str]] = Counter()
        for rows in batches:
            for text in rows["text"]:
                if text:
                    seen.update([("name", p.lower(), p, w) for p, w in _mentions(text)])
                    for a, b in _numbers(text):
                        words = text[max(0, a - 48) : a].split()[-4:]
                        form = shape(text[a:b])
                        seen.update([("number", form, w, "") for w in {x.strip(">|(),;<").lower() for x in words} if w])
                    seen.update([("mail", signs, address.lower(), "") for _, _, signs, address in _mails(text)])
                    post = _POSTCODES.search(text)
                    if post:
                        for found in _addresses(flattened(text), post.start()):
                            seen[("place", found[-1][2], found[-1][3], "")] += 1  # that of a seed, or else the tightest reading
            if len(seen) > 300_000:
                yield rows_of(seen)
        yield rows_of(seen)

    def rows_of(seen: Counter[tuple[str, str, str, str]]) -> pd.DataFrame:
        out = pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "a", "b", "c", "n"]).astype({"n": "int64"})
        seen.clear()
        return out

    return texts.select("text").mapInPandas(count, "kind string, a string, b string, c string, n long").groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))


def flattened(text: str) -> str:
    """The text in one line of the same length: line breaks with marks of quoting as \\x02, paragraph breaks as \\x01."""
    if _MARKED.search(text):
        return _BREAK.sub(lambda m: ("\x01" if m.group().count("\n") > 1 else "\x02") + " " * (m.end() - m.start() - 1), text)
    return text.replace("\n\n", "\x01 ").replace("\n", "\x02")  # no line begins with a mark of quoting: the same, faster


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what is written like a number of a person: seven characters and six digits or more, no date."""
    at = 0
    for d in _DIGITS.finditer(text):
        if d.end() <= at or d.end() - d.start() < 15 and _DATE.match(text, d.start()):
            continue  # taken already, or a date, as most are
        stop = min(len(text), d.end() + 14)
        for m in _NUMBER.finditer(text, max(at, d.start() - 5), stop):
            if m.end() == stop < len(text):
                m = _NUMBER.match(text, m.start()) or m  # it goes on beyond the window
            if m.end() <= at:
                continue
            at = m.end()
            if m.end() - m.start() >= 7 and sum(map(str.isdigit, m.group())) >= 6 and not _DATE.match(m.group()):
                yield m.start(), m.end()


def _local(text: str, end: int) -> int:
    """Where the local part of a mail address that ends at ``end`` begins."""
    reach = 48
    while (n := len(_LOCAL.match(text[max(0, end - reach) : end][::-1]).group())) == reach:
        reach *= 8  # a longer one than most
    return end - n


def _mails(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, joining signs, address) of everything written like a mail address, whatever the signs."""
    i = text.find("@")
    while i >= 0:
        start, domain = _local(text, i), _DOMAIN.match(text, i + 1)
        if start < i and domain:
            end = domain.end() - (text[domain.end() - 1] in "-_")
            yield start, end, JOINTS, text[start:end]
        i = text.find("@", i + 1)
    done = 0
    for at in _BRACKETED.finditer(text):
        i = at.start() - (text[at.start() - 1 : at.start()] == " ")
        rest = _SPELLED.match(text, at.end()) if at.start() >= done else None
        if rest and (start := _local(text, i)) < i:
            points = _POINT.findall(rest.group(2))
            done = rest.end()
            yield start, done, f"{at.group()[1:-1].lower()}|{points[0].lower() if points else '.'}", f"{text[start:i]}@{rest.group(1)}{_POINT.sub('.', rest.group(2))}"


def _addresses(flat: str, start: int = 0) -> Iterator[list[tuple[int, int, str, str]]]:
    """For each postcode the readings (start, end, word of the street, form of the postcode) of the address it may end, up to one with a seed word."""
    done = 0
    for p in _POSTCODES.finditer(flat, start):
        if p.start() < done:
            continue
        found, at = [], max(done, p.start() - _BEFORE)
        letters = re.search(r"[A-Z]{0,2}$", flat[max(0, p.start() - 2) : p.start()]).group()
        form = _POST_FORM.sub("A", re.sub(r"\d", "9", (letters + p.group()).replace("\x02", " ")))
        while (m := _ADDRESS.search(flat, at, p.end() + _AFTER)) and m.start() < p.start():
            if p.end() <= m.end():
                key = f"-{m['end'].lower()}" if m["end"] else (m["last"] or m["type"] or m["first"]).rstrip(".").lower()
                found.append((m.start(), m.end(), key, form))
                if key in STREETS:
                    break
            at = m.start() + 1
        if found:
            yield found
            done = found[-1][1]


def _mentions(text: str) -> Iterator[tuple[str, str]]:
    """(word before, capitalised word); ``<line>`` stands before the first word of a line."""
    for m in _CAPITAL.finditer(text):
        a, b = m.span()
        following = text[b + 1 : b + 2]
        if following == "&" or following.isupper():
            after = text[b : b + 14].split()
            if after and (after[0] == "&" or after[0].strip(".,").lower() in _THINGS):
                yield "<thing>", m.group()
                continue
        before = text[max(0, a - 24) : a].rstrip(" >|»*\t")
        words = before.rsplit(None, 1)
        yield words[-1] if words and before[-1] != "\n" else "<line>", m.group()


def score_names(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """(word, is_first, is_last, clear, left): trusted names and trusted left contexts after the rounds.

    A context's trust is the share of its mentions whose word is trusted, a word's the share of its
    mentions in trusted contexts. After a first name stands a surname. Every step is a join and an
    aggregation of the graph, combined before the shuffle.
    """
    names = seeds
    for _ in range(ROUNDS):
        firsts = names.where("is_first = 1").select(F.col("word").alias("prev"), F.lit(1).alias("after_first"))
        edges = graph.join(firsts, "prev", "left").withColumn("left", F.when((F.col("after_first") == 1) & ~F.col("left").startswith("<"), F.lit("<first>")).otherwise(F.col("left")))
        trusted = edges.where("left <> '<line>'").join(names.where(~F.lower("word").isin(*_EVERYDAY)).select("word", F.lit(1.0).alias("s")), "word", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        contexts = trusted.groupBy("left").agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("trust"), F.sum("n").alias("support")).where("support >= 3")
        scored = edges.join(contexts, "left", "left").groupBy("word").agg((F.sum(F.col("n") * F.coalesce("trust", F.lit(0.0))) / F.sum("n")).alias("score"), F.sum("n").alias("n"), (F.sum(F.when(F.col("left") == "<first>", F.col("n")).otherwise(0)) / F.sum("n")).alias("as_last"))
        found = scored.where("score >= 0.7 AND n >= 3").select("word", (F.col("as_last") < 0.5).cast("int").alias("is_first"), (F.col("as_last") >= 0.5).cast("int").alias("is_last"))
        names = cut(names.unionByName(found).groupBy("word").agg(F.max("is_first").alias("is_first"), F.max("is_last").alias("is_last")))
    clear = scored.select("word", (F.col("score") >= 0.4).cast("int").alias("clear"))
    rows = names.join(clear, "word", "left").select("word", F.expr(f"is_first * {FIRST} + is_last * {LAST} + coalesce(clear, 0) * {CLEAR}").alias("flags"))
    return rows.unionByName(contexts.where("trust >= 0.6 AND left NOT IN ('<first>', '<line>', '<thing>')").select(F.col("left").alias("word"), F.lit(LEFT).alias("flags")))


def name_flags(graph: DataFrame, messages: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, flags) of the trusted names and contexts."""
    names = graph.where("kind = 'name'").select(F.col("a").alias("left"), F.col("b").alias("prev"), F.col("c").alias("word"), "n")
    rows = score_names(names, header_names(messages)).groupBy(F.xxhash64("word").alias("h")).agg(F.bit_or("flags").alias("flags")).orderBy("h").toArrow()
    return rows.column("h").to_numpy(), rows.column("flags").to_numpy().astype(np.uint8)


def mail_joints(graph: DataFrame, messages: DataFrame) -> frozenset[str]:
    """The signs that join mail addresses: those under which addresses of the mail headers are mentioned, too."""
    edges = graph.where("kind = 'mail'").select(F.col("a").alias("signs"), F.col("b").alias("address"), "n")
    every = F.concat_ws(" ", "from_email", "to_emails", "cc_emails")
    seeds = messages.select(F.explode(F.regexp_extract_all(F.lower(every), F.lit(r"[^\s<>,;\"]+@[^\s<>,;\"]+"), 0)).alias("address")).distinct()
    for _ in range(ROUNDS):
        met = edges.join(seeds.withColumn("s", F.lit(1.0)), "address", "left")
        trusted = cut(met.groupBy("signs").agg((F.sum(F.col("n") * F.coalesce("s", F.lit(0.0))) / F.sum("n")).alias("trust"), F.sum("n").alias("n")).where((F.col("trust") >= INDUCED) & (F.col("n") >= 3)).select("signs"))
        seeds = seeds.union(edges.join(trusted, "signs").select("address")).distinct()
    return frozenset(r["signs"] for r in trusted.toLocalIterator())


def street_words(graph: DataFrame) -> frozenset[str]:
    """The words that streets are named with: the seeds, and others that stand before postcodes of the seeds' forms."""
    edges = graph.where("kind = 'place'").select(F.col("a").alias("key"), F.col("b").alias("form"), "n")
    known = edges.select("key").distinct().where(F.col("key").isin(*STREETS))
    for _ in range(ROUNDS):
        forms = edges.join(known.withColumn("s", F.lit(1.0)), "key", "left").groupBy("form").agg((F.sum(F.col("n") * F.coalesce("s", F.lit(0.0))) / F.sum("n")).alias("trust"))
        found = edges.join(forms, "form").groupBy("key").agg((F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("score"), F.sum("n").alias("n")).where("score >= 0.3 AND n >= 3").select("key")
        known = cut(known.union(found).distinct())
    return STREETS | {r["key"] for r in known.toLocalIterator()}


def number_shapes(graph: DataFrame) -> dict[str, str]:
    """Type of every number shape, scored from the cue words before its numbers over all texts."""
    every = graph.where("kind = 'number'").select(F.col("a").alias("shape"), F.col("b").alias("cue"), F.col("n").alias("count"))
    total = every.agg(F.sum("count")).first()[0] or 0
    usual = every.groupBy("shape").agg(F.sum("count").alias("all")).where(F.col("all") >= SHAPE_SHARE * total).select("shape")  # at most 1 / SHAPE_SHARE
    edges = cut(every.join(usual, "shape"))
    kinds = list(CUES)
    seed = reduce(lambda a, k: a.when(F.col("cue").isin(*CUES[k].split("|")), F.lit(k)), kinds, F.when(F.lit(False), F.lit("")))
    cues = edges.select("cue").distinct().withColumn("kind", seed).where("kind IS NOT NULL")
    cues = cues.select("cue", *((F.col("kind") == k).cast("double").alias(k) for k in kinds))
    for _ in range(ROUNDS):
        shapes = edges.join(cues, "cue").groupBy("shape").agg(*(F.sum(F.col("count") * F.col(k)).alias(k) for k in kinds))
        total = sum((F.col(k) for k in kinds), F.lit(1.0))
        shapes = cut(shapes.select("shape", *((F.col(k) / total).alias(k) for k in kinds)))
        induced = edges.join(shapes, "shape").groupBy("cue").agg(F.sum("count").alias("n"), *((F.sum(F.col("count") * F.col(k)) / F.sum("count")).alias(k) for k in kinds)).where("n >= 3 AND " + "greatest(" + ", ".join(kinds) + ") >= 0.8")
        cues = cues.unionByName(induced.join(cues.select("cue"), "cue", "left_anti").select("cue", *kinds))
    best = F.greatest(*(F.col(k) for k in kinds))
    rows = shapes.where((best >= 0.5) & (F.col("OTHER") < best)).select("shape", F.when(F.col("PHONE") == best, "PHONE").otherwise("ID_NUMBER").alias("kind")).collect()
    return {r["shape"]: r["kind"] for r in rows}


class Finder:
    """Finds the personal information of one text at a time."""

    def __init__(self, flags: tuple[np.ndarray, np.ndarray], shapes: dict[str, str], joints: frozenset[str], streets: frozenset[str]):
        (self.hashes, self.values), self.shapes, self.joints, self.streets = flags, shapes, joints, streets
        self.known: dict[str, int] = {}

    def flags_of(self, word: str) -> int:
        h = name_hash(word)
        i = int(np.searchsorted(self.hashes, h))
        return int(self.values[i]) if i < len(self.hashes) and self.hashes[i] == h else 0

    def flags(self, word: str) -> int:
        f = self.known.get(word)
        if f is None:
            if len(self.known) > 300_000:
                self.known.clear()
            f = self.flags_of(word)
            if not f & (FIRST | LAST) and word.isupper() and len(word) > 2:
                f = self.flags_of(word.capitalize()) & ~CLEAR
            if word.lower() in _EVERYDAY:
                f &= ~CLEAR
            if not f & (FIRST | LAST) and not word.isascii():  # a name decoded with the wrong encoding is one still
                f = next((g for _, _, w in _candidates(word) if (g := self.flags_of(w)) & (FIRST | LAST)), f)
            self.known[word] = f
        return f

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type), in order and apart from each other."""
        flat = flattened(text)
        spans: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(a: int, b: int, kind: str) -> None:
            if not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                spans.append((a, b, kind))

        for a, b, signs, _ in _mails(flat):
            if signs in self.joints:
                add(a, b, "EMAIL")
        for found in _addresses(flat):
            best = next((x for x in reversed(found) if x[2] in self.streets), None)
            if best:
                a, b = next((x[0], x[1]) for x in found if x[2] == best[2])
                add(a, b, "ADDRESS")
        for a, b in _numbers(flat):
            kind = self.shapes.get(shape(flat[a:b]))
            if kind:
                add(a, b, kind)
        taken.sort()
        for a, b in self.names(flat):
            if not any(a < y and x < b for x, y in taken):
                spans.append((a, b, "NAME"))
        return sorted(spans)

    def names(self, flat: str) -> Iterator[tuple[int, int]]:
        known, done = self.known, 0
        for m in _CAPITAL.finditer(flat):
            w = m.group()
            f = known.get(w)
            if f is None:
                f = known[w] = self.flags(w.rstrip("'’-*_"))
            if not f & (FIRST | LAST) or m.start() < done:
                continue
            a = m.start()
            w = w.rstrip("'’-*_")
            b = a + len(w)
            following = _CAPITAL.search(flat, m.end(), m.end() + 48)
            nxt = (following.start(), following.end(), following.group()) if following else None
            if nxt and nxt[2].lower() in _THINGS and _ADJACENT.fullmatch(flat[b : nxt[0]]):
                done = nxt[1]  # a company's or a street's name
                continue
            if f & FIRST and nxt:
                gap = flat[b : nxt[0]]
                adjacent, middle = _ADJACENT.fullmatch(gap), _MIDDLE.fullmatch(gap)
                last = nxt[2].rstrip("'’-*_")
                g = self.flags(last)
                same_case = last.isupper() == w.isupper()
                if (adjacent or middle) and same_case and (g & LAST or middle or (not gap.startswith("\x02") and self._surname_like(last, f))) and not self._thing(flat, nxt[0] + len(last)):
                    yield a, nxt[0] + len(last)
                    done = nxt[1]
                    continue
            if f & LAST and nxt and flat[b : nxt[0]] in (", ", ",\x02") and self.flags(nxt[2].rstrip("'’-*_")) & FIRST and not f & FIRST:
                end = nxt[0] + len(nxt[2].rstrip("'’-*_"))
                yield a, end
                done = nxt[1]
                continue
            initial = _INITIAL_BEFORE.search(flat[max(0, a - 8) : a])
            if f & LAST and initial and not self._thing(flat, b):
                yield a - (len(flat[max(0, a - 8) : a]) - initial.start()), b
            elif self._alone(flat, a, b, w, f):
                yield a, b

    def _surname_like(self, word: str, f: int) -> bool:
        """Whether an unknown word after a first name can be its surname: garbled ones can, common words not."""
        return bool(f & CLEAR) and len(word) > 3 and word[1:] != word[1:].upper() and not word.isascii() and self.flags(word.lower()) == 0

    def _thing(self, flat: str, end: int) -> bool:
        """Whether the words up to ``end`` are part of a company's or street's name."""
        after = flat[end : end + 16].replace("\x02", "\n").split("\n")[0].split()
        return bool(after) and (after[0] == "&" or after[0].strip(".,").lower() in _COMPANY or after[0].strip(".,").lower() in _STREET)

    def _alone(self, flat: str, a: int, b: int, word: str, f: int) -> bool:
        """Whether a lone name part is a mention of a person."""
        line_start = a == 0 or not flat[:a].rstrip(" *")[-1:].strip("\x01\x02 ")
        rest = flat[b : b + 12]
        line_end = not rest.strip(" ,!.*")[:1].strip("\x01\x02") or rest.lstrip(" ")[:1] in ("\x01", "\x02", "")
        words = flat[max(0, a - 30) : a].translate(_GAPS).rsplit(None, 1)
        before = words[-1].lower() if words else ""
        left = bool(before) and bool(self.flags(before) & LEFT)
        title = before.rstrip(".") in _TITLE
        if self._thing(flat, b) or before in ("&", "c/", "the", "of") or flat[max(0, a - 2) : a].strip() == "&":
            return False
        if f & FIRST:
            if f & CLEAR:
                return True
            return left or title or line_start and (line_end or rest[:1] in ",:")
        return title or (left and bool(f & CLEAR)) or (bool(f & CLEAR) and line_start and line_end)


def learn(texts: DataFrame, messages: DataFrame) -> tuple:
    """Everything a :class:`Finder` needs, learned from all texts and the mail headers."""
    graph = cut(evidence(texts))
    return name_flags(graph, messages), number_shapes(graph), mail_joints(graph, messages), street_words(graph)


def find_personal(texts: DataFrame, model: tuple, replaced: bool = False) -> DataFrame:
    """(field, rec_id, pii_type, pii_value) found in the texts (field, rec_id, text); with ``replaced``
    (field, rec_id, clean): the texts with ``[TYPE]`` in place of each.

    Null and empty texts have none and stay as they are; a value mentioned again is found again (and
    made distinct by the caller). Whole texts are searched where they are read, without a shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for rows in batches:
            out = []
            for field, rec, text in zip(rows["field"], rows["rec_id"], rows["text"], strict=True):
                spans = finder.find(text) if text else []
                if replaced:
                    parts, at = [], 0
                    for a, b, kind in spans:
                        parts += [text[at:a], f"[{kind}]"]
                        at = b
                    out.append((field, rec, "".join(parts) + text[at:] if text else text))
                else:
                    out += {(field, rec, kind, text[a:b]) for a, b, kind in spans}
            yield pd.DataFrame(out, columns=columns).astype({"rec_id": "int64"})

    columns = ["field", "rec_id", "clean"] if replaced else ["field", "rec_id", "pii_type", "pii_value"]
    return texts.select("field", "rec_id", "text").mapInPandas(run, ", ".join(f"{c} {'long' if c == 'rec_id' else 'string'}" for c in columns))
