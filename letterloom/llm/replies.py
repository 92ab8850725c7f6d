"""Reducing each mail to the text its sender newly wrote.

Quoted and forwarded mails show by their marks (quote signs, introducing lines, header blocks). All
else that is not new was written before: paragraphs of older mails of the thread, the sender's own
closings, and the formulas, disclaimers and banners that many senders' mails end or begin with. For
these, dictionaries are formed by Spark from all mails: per sender the lines and sentences that come
again at the end of that sender's mails, over all senders those that come again with many of them,
and per thread the paragraphs of earlier generations. A paragraph that compresses abnormally well
under its dictionary is a suspect; its lines are flagged as far as an exact overlap confirms them, and
paragraphs that do not compress are preserved as new.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.session import cut

#: A closing comes again in so many mails of its sender, a shared one with so many senders; and in this share of the
#: sender's or of all mails, so that what comes again by chance is none and the shared ones stay bounded in number.
OWN, SHARED = 3, 4
HABIT, COMMON = 0.01, 1e-3
#: Closings are followed by at most so many paragraphs on average.
AFTER = 1.15
#: Saved share of a paragraph's compressed size that is abnormal: new text saves next to nothing.
GAIN = 0.25
#: Bytes that a paragraph of an earlier mail must save: less is what greetings and thanks save by chance.
EVIDENCE = 40

_SEPARATOR = re.compile(r"^(?:--+|__+|\*\*+|==+|~~+|—+|–+|(?:[*·•_~=-] ?){3,})\s*$")
_QUOTE = re.compile(r"^\s{0,3}(?:[>»|]|: |:$|[A-Z]{1,3}>)")
_FORWARD = re.compile(r"^\W{0,3}(?:-{3,}|_{3,}|={3,}) ?\S[^\d]*\S ?(?:-{3,}|_{3,}|={3,})\s*$")
_HEADER = re.compile(r"^\*?[^\W\d_][\w -]{0,14}\*? ?: ?\*?\S")
_WHEN = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\b\d{1,2}:\d{2}\b|\b(?:19|20)\d{2}\b")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
_ENDS = ".!?:…"
_MARKS = re.compile(r"^[\s>»|]+")
_BEYOND = re.compile(r"[^\x00-\x7f]+")


def _plain(text: str) -> str:
    return " ".join(text.split())


def _is_intro(line: str) -> bool:
    """Whether a line introduces a quotation: it ends with a colon and names a time or an address."""
    end = line.rstrip()
    return end.endswith(":") and len(end.split()) <= 40 and (bool(_WHEN.search(end)) or bool(_MAIL.search(end)))


def _is_prose(line: str) -> bool:
    """Whether a line may belong to running text: many words, or a few that end as sentences do."""
    words = line.split()
    return "|" not in words and (len(words) > 12 or len(words) > 2 and words[-1].rstrip("\"'»”’)*_")[-1:] in (".", "!", "?", "…"))


def _may_begin_block(lines: list[str]) -> Iterator[int]:
    """Numbers of the lines with an address, as the first header of a block has one, and of the line above each."""
    above, given = -1, -1
    for i, x in enumerate(lines):
        if "@" in x:
            if above > given:
                yield above
            yield i
            given = i
        if x and not x.isspace():
            above = i


def _mark_quotes(lines: list[str]) -> list[bool]:
    """Lines that are quoted or forwarded, by their marks."""
    n = len(lines)
    out = [bool(x) and not (x[0].isalnum() and ">" not in x[:4]) and bool(_QUOTE.match(x)) for x in lines]
    every = "\n".join(lines)
    i = 0
    while i < n and "\n    " in every:  # quotations marked by indentation, right after their introducing line
        if not out[i] and ":" in lines[i] and _is_intro(lines[i]):
            j = i + 1
            while j < n and not lines[j].strip():
                j += 1
            if j < n and lines[j].startswith("    "):
                k = j
                while k < n and (lines[k].startswith("    ") or not lines[k].strip() or (k + 1 < n and lines[k + 1].startswith("    ") and len(lines[k]) <= 30)):
                    out[k] = bool(lines[k].strip())
                    k += 1
                i = k - 1
        i += 1
    for i in _may_begin_block(lines) if "@" in every else ():  # from the header block of a forwarded or original mail on, everything is older
        line = lines[i].strip()
        if out[i]:
            continue
        plain = line[0].isalnum()  # neither a separator nor the line of a forwarded mail
        rule = not plain and (bool(_FORWARD.match(line)) or (_SEPARATOR.match(line) and len(line) >= 8))
        start = i + 1 if rule else i
        heads = [x for x in lines[start : start + 6] if x.strip()]
        block = 0
        for x in heads:
            if not (_HEADER.match(x.strip()) or block and (_MAIL.search(x) or x.startswith(" "))):
                break
            block += 1
        if block >= 3 and _MAIL.search(heads[0]) and (rule or any(_WHEN.search(x) for x in heads[1:block])):
            out[i:] = [bool(x.strip()) for x in lines[i:]]
            break
    return out


def key_of(unit: str) -> int:
    """Hash of a line or sentence, the same for any spacing and, in mostly Latin text, any wrong decoding."""
    return _plain_key(_plain(unit))


def _plain_key(unit: str) -> int:
    """:func:`key_of` of a unit whose spacing is plain already."""
    plain = unit.rstrip(",.!;:–- ").lower() or unit
    if not plain.isascii():
        bare = _BEYOND.sub("?", plain)
        if 2 * (len(bare) - bare.count("?")) > len(plain):
            plain = bare
    return xxhash.xxh64_intdigest(plain) - (1 << 63)


_often_asked = lru_cache(1 << 15)(_plain_key)


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _paragraphs(lines: list[str], old: list[bool]) -> Iterator[list[list[int]]]:
    """The sender's own stretches between quotations, each as its paragraphs' line numbers."""
    stretch: list[list[int]] = []
    fresh = True
    for i, x in enumerate([*lines, None]):
        if x is None or old[i]:
            if stretch:
                yield stretch
            stretch, fresh = [], True
        elif not x.strip():
            fresh = True
        else:
            if fresh:
                stretch.append([])
            stretch[-1].append(i)
            fresh = False


def _units(lines: list[str], paragraph: list[int]) -> dict[str, None]:
    """The lines and, if it has more than one line or sentence, the sentences of a paragraph."""
    every = [_plain(lines[i]) for i in paragraph]
    return _parts(every, " ".join(every))


def _parts(every: list[str], whole: str) -> dict[str, None]:
    """:func:`_units` of lines whose only blanks are single spaces, and of all of them."""
    for end in _ENDS:
        whole = whole.replace(end + " ", end + "\n")
    return dict.fromkeys([*every, *whole.split("\n")])


@lru_cache(1 << 16)
def _gain(text: str, known: str) -> float:
    """Share of the compressed size of ``text`` that the dictionary ``known`` saves, the best of its windows."""
    raw = text.encode()

    def size(dictionary: bytes) -> int:
        packer = zlib.compressobj(9, zlib.DEFLATED, -15 if len(dictionary) + len(raw) > 4096 else -12, 5, zlib.Z_DEFAULT_STRATEGY, dictionary)
        return len(packer.compress(raw)) + len(packer.flush())

    alone, every = size(b""), known.encode()
    return max(1 - size(every[at : at + 32768]) / alone for at in range(0, len(every), max(16384, 32768 - len(raw)))) if every else 0.0


class Closings:
    """Dictionaries of one mail: its sender's closings and name, and what is shared by many senders."""

    def __init__(self, shared: dict[int, str], own: frozenset[int], names: frozenset[str]):
        self.shared, self.own, self.names = shared, own, names

    def _known(self, unit: str, kind: str) -> bool:
        k = _often_asked(unit)
        if self.shared.get(k) == kind or kind == "closing" and k in self.own:
            return True
        if kind != "closing" or not self.names or unit[-1] in ",:!?":
            return False
        bare = unit.rstrip(",.!;:–- ")
        if bare.count(" ") > 3 + bare.count("."):
            return False
        words = bare.lower().replace(".", " ").split()
        return 0 < len(words) <= 4 and self.names.issuperset(words)

    def covered(self, lines: list[str], paragraph: list[int], kind: str) -> list[bool] | None:
        """Per line of a paragraph whether it lies in exact overlaps with the dictionaries; None unless its gain is abnormal."""
        known = [u for u in _units(lines, paragraph) if u and self._known(u, kind)]
        if not known:
            return None
        whole = _plain(" ".join(lines[i] for i in paragraph))
        framed = "\n" + "\n".join(known) + "\n"
        if _gain(whole, " ".join(known)) < GAIN and all(_gain(f"\n{_plain(lines[i])}\n", framed) < GAIN for i in paragraph):
            return None
        mask = bytearray(len(whole))
        for u in known:
            at = whole.find(u)
            while at >= 0:
                mask[at : at + len(u)] = b"\x01" * len(u)
                at = whole.find(u, at + len(u))
        out, at = [], 0
        for i in paragraph:
            n = len(_plain(lines[i]))
            out.append(sum(mask[at : at + n]) >= 0.8 * n)
            at += n + 1
        return out


def older_lines(body: str, ancestors: frozenset[int], closings: Closings) -> list[int]:
    """Numbers (from 1) of the non-blank lines of ``body`` that its sender did not newly write.

    ``ancestors`` holds the keys of this body's paragraphs that earlier mails of the thread have, too.
    """
    lines = body.split("\n")
    n = len(lines)
    old = _mark_quotes(lines)
    older = [t for t in (_plain(" ".join(lines[i] for i in p)) for stretch in _paragraphs(lines, old) for p in stretch) if text_key(t) in ancestors] if ancestors else []
    for i in range(n):  # words that wrapping pushed out of a quoted line
        if old[i] or i == 0 or not old[i - 1] or not lines[i].strip():
            continue
        bare, last = _plain(lines[i]), _plain(lines[i - 1].lstrip(" >»|"))
        if i + 1 < n and old[i + 1] and len(bare) <= 30:
            old[i] = True
        elif len(lines[i - 1]) >= 55 and len(bare) <= 30 and last[-1:] not in ".!?:" and bare[-1] in ".!?" and len(bare) <= 18:
            old[i] = True
    for i in range(n):  # introducing lines, possibly over two lines
        if old[i] or ":" not in lines[i] or not _is_intro(lines[i]):
            continue
        quoted = next((old[j] for j in range(i + 1, n) if lines[j].strip()), False)
        if not (quoted or _MAIL.search(lines[i])):
            continue
        old[i] = True
        start = lines[i].lstrip()
        k = i - 1
        if k >= 0 and lines[k].strip() and not old[k] and (not _WHEN.search(start) or start[0] == "<" or start[0].islower()) and (_WHEN.search(lines[k]) or _MAIL.search(lines[k])):
            old[k] = True
    known = " ".join(older)
    for paragraph in [p for stretch in _paragraphs(lines, old) for p in stretch] if older else []:
        text = _plain(" ".join(lines[i] for i in paragraph))
        if text in older and _gain(text, known) * len(zlib.compress(text.encode())) >= EVIDENCE:
            for i in paragraph:
                old[i] = True
    for k, stretch in enumerate(list(_paragraphs(lines, old))):
        if k == 0:
            stretch = _without_banners(lines, old, stretch, closings)
        _mark_closing(lines, old, stretch, closings)
    return [k + 1 for k in range(n) if old[k] and lines[k].strip()]


def _without_banners(lines: list[str], old: list[bool], stretch: list[list[int]], closings: Closings) -> list[list[int]]:
    """Flags the banners that a mail begins with, and a separator after them; gives the rest."""
    at = 0
    while at < len(stretch) and stretch[at][0] < sum(map(len, stretch[: at + 1])) + 2 * at + 2:
        covered = closings.covered(lines, stretch[at], "banner")
        if covered is None or not covered[0]:
            break
        for i, c in zip(stretch[at], covered, strict=True):
            old[i] = c
        if not all(covered):
            return [stretch[at][covered.index(False) :], *stretch[at + 1 :]]
        at += 1
        if at < len(stretch) and len(stretch[at]) == 1 and _SEPARATOR.match(lines[stretch[at][0]]):
            old[stretch[at][0]] = True
            at += 1
    return stretch[at:]


def _mark_closing(lines: list[str], old: list[bool], stretch: list[list[int]], closings: Closings) -> None:
    """Flags the closing of a stretch: from its end upwards, as far as paragraphs lie in the dictionaries.

    Between them may stand lines that are no prose: numbers, addresses, separators.
    """
    start: tuple[int, int] | None = None
    for p in range(len(stretch) - 1, -1, -1):
        paragraph = stretch[p]
        covered = closings.covered(lines, paragraph, "closing")
        if covered is not None and any(covered):
            first = len(paragraph)
            for k in range(len(paragraph) - 1, -1, -1):
                if covered[k]:
                    first = k
                elif _is_prose(lines[paragraph[k]]):
                    break
            if first < len(paragraph):
                if first == 1 and len(lines[paragraph[0]].split()) <= 5 and lines[paragraph[0]].rstrip()[-1] not in ".?:" and (p or start is None and len(paragraph) == 2 and len(stretch) > 1):
                    first = 0  # a formula that few use, right above the name
                start = (p, first)
            if first:
                break
        elif len(paragraph) == 1 and _SEPARATOR.match(lines[paragraph[0]]) and start is not None:
            start = (p, 0)
        elif any(_is_prose(lines[i]) for i in paragraph):
            break
    if start is None:
        return
    p, first = start
    above = stretch[p][first - 1] if first else stretch[p - 1][-1] if p else None
    if above is not None and _SEPARATOR.match(lines[above]):
        old[above] = True
    for k, paragraph in enumerate(stretch[p:]):
        for i in paragraph[first if k == 0 else 0 :]:
            old[i] = True


# --- on tables
def own_texts(bodies: DataFrame) -> DataFrame:
    """(parse_id, mail, known, sender, paragraphs, quoted): hashes of the senders' own text, each body cut once.

    Of a paragraph: how many follow in its stretch (``after``), whether it begins the mail, ``next`` as the key
    of the line that begins the second paragraph of such a mail, else 0, the key of its ``text`` and the ``keys`` of its lines
    and sentences. What a mail quotes stands in the mail it answers; only where that one is not here (``orphan``) are
    its ``quoted`` paragraphs taken from it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            after, begins, follow, texts, keys, quoted = [], [], [], [], [], []
            to_paragraph, to_key, to_quoted = [0], [0], [0]
            for body, orphan in zip(rows.column("body").to_pylist(), rows.column("orphan").to_pylist(), strict=True):
                lines = body.split("\n")
                old = _mark_quotes(lines)
                first = len(texts)
                for k, stretch in enumerate(_paragraphs(lines, old)):
                    second = key_of(lines[stretch[1][0]]) if k == 0 and len(stretch) > 1 else 0
                    for p, paragraph in enumerate(stretch):
                        every = [_plain(lines[i]) for i in paragraph]
                        whole = " ".join(every)
                        keys += [_plain_key(u) for u in _parts(every, whole) if u]
                        to_key.append(len(keys))
                        texts.append(text_key(whole))
                        after.append(len(stretch) - 1 - p)
                        begins.append(int(k == p == 0))
                        follow.append(second if k == p == 0 else 0)
                if orphan:
                    bare = [_MARKS.sub("", x) if o else "" for x, o in zip(lines, old, strict=True)]
                    quoted += {text_key(_plain(" ".join(bare[i] for i in p))) for stretch in _paragraphs(bare, [False] * len(bare)) for p in stretch}.difference(texts[first:])
                to_paragraph.append(len(texts))
                to_quoted.append(len(quoted))
            long, short = pa.int64(), pa.int32()
            listed = lambda to, of: pa.ListArray.from_arrays(pa.array(to, short), of)
            each = pa.StructArray.from_arrays([pa.array(after, long), pa.array(begins, long), pa.array(follow, long), pa.array(texts, long), listed(to_key, pa.array(keys, long))], names=["after", "first", "next", "text", "keys"])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("parse_id", "mail", "known", "sender")), listed(to_paragraph, each), listed(to_quoted, pa.array(quoted, long))], names=["parse_id", "mail", "known", "sender", "paragraphs", "quoted"])

    seen = bodies.select("parse_id", F.xxhash64("message_id").alias("mail"), F.col("message_id").isNotNull().alias("known"), "sender", "body", "orphan")
    return seen.mapInArrow(read, "parse_id long, mail long, known boolean, sender long, paragraphs array<struct<after: long, first: long, next: long, text: long, keys: array<long>>>, quoted array<long>")


def closing_units(texts: DataFrame) -> DataFrame:
    """(sender, key, n, after, first, low, high, next): lines and sentences of the senders' own text, counted.

    ``after`` sums how many paragraphs follow, ``first`` how often it begins the mail, ``low`` and ``high``
    differ if it comes from more than one mail. Counts are combined before the shuffle, so a sender
    of most mails is no single task's work.
    """
    seen = texts.select("sender", "mail", F.explode("paragraphs").alias("p")).select("sender", "mail", "p.after", "p.first", "p.next", F.explode("p.keys").alias("key"))
    return seen.groupBy("sender", "key").agg(F.max("next").alias("next"), F.count("*").alias("n"), F.sum("after").alias("after"), F.sum("first").alias("first"), F.min("mail").alias("low"), F.max("mail").alias("high"))


def closing_dictionaries(units: DataFrame, senders: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """((sender, key) of the senders' own closings, kinds of the shared units by key).

    A shared unit stands with several senders and in ``COMMON`` of all mails, so there are at most a
    few per ``1 / COMMON``. It is a closing if little follows it. It is a banner if it begins mails and
    what comes after it are lines that otherwise begin mails themselves, such as greetings.
    """
    written = senders.groupBy("sender").agg(F.count("*").alias("mails"))
    mails = senders.count()
    own = units.where((F.col("sender").isNotNull()) & (F.col("n") >= OWN) & (F.col("low") != F.col("high")) & (F.col("after") <= AFTER * F.col("n"))).join(written, "sender").where(F.col("n") >= HABIT * F.col("mails")).select("sender", "key")
    every = units.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "after", "first")), F.count("*").alias("senders"))
    shared = cut(every.where((F.col("senders") >= SHARED) & (F.col("n") >= max(SHARED, COMMON * mails))))
    starters = shared.where("first >= 0.5 * n").select(F.col("key").alias("next"), F.lit(1).alias("starts"))
    followed = units.where("next <> 0").select("key", "next", F.lit(1).alias("n")).join(F.broadcast(shared.where("first >= 0.9 * n").select("key")), "key", "left_semi")
    before = followed.join(F.broadcast(starters), "next", "left").groupBy("key").agg((F.sum(F.when(F.col("starts") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).where("share >= 0.3")
    kinds = shared.join(before, "key", "left").select("key", F.when(F.col("share").isNotNull(), "banner").when((F.col("after") <= AFTER * F.col("n")) & (F.col("first") < 0.5 * F.col("n")), "closing").alias("kind"))
    return own, {r["key"]: r["kind"] for r in kinds.where("kind IS NOT NULL").toLocalIterator()}


def thread_generations(messages: DataFrame) -> DataFrame:
    """(message_id, thread, generation) as hashes: mails of one thread share the key, answers come after what they answer.

    Threads of any length are followed to their end. Mails that answer each other in a circle begin their
    thread together: none of them is older, and what answers them comes after.
    """
    known = messages.where("message_id IS NOT NULL").groupBy("message_id").agg(F.min(F.struct(F.coalesce("in_reply_to", F.lit("")).alias("up"), F.coalesce("thread_id", F.lit("")).alias("thread"))).alias("m"))
    h = lambda c: F.when(F.col(c) != "", F.xxhash64(c))
    first = known.select(F.xxhash64("message_id").alias("id"), h("m.up").alias("up"), h("m.thread").alias("thread"))
    nodes, circling = _followed(first)
    if circling:
        circle = nodes.join(nodes.where("open").select(F.col("up").alias("id")).distinct(), "id", "left_semi").select("id", F.coalesce("thread", "low").alias("shared"))
        apart = first.join(circle, "id", "left").select("id", F.when(F.col("shared").isNull(), F.col("up")).alias("up"), F.coalesce("thread", "shared").alias("thread"))
        nodes, _ = _followed(apart)
    return nodes.select("id", F.coalesce("thread", "up", "id").alias("thread"), "generation")


def _followed(first: DataFrame) -> tuple[DataFrame, int]:
    """(id, up, thread, generation, low, open) of mails (id, up, thread) followed up as far as their mails are here, and how many are still open.

    Each round looks twice as far up and closes those that reach an end, so a round that closes none leaves
    only mails whose way runs into a circle. These go on until ``up`` lies in the circle and ``low``, the
    least id on the way, has gone round it.
    """
    nodes = first.select("*", F.col("up").isNotNull().cast("long").alias("generation"), F.col("id").alias("low"), F.col("up").isNotNull().alias("open"))
    steps, left = 1, -1
    while True:
        above = nodes.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("thread").alias("thread2"), F.col("generation").alias("more"), F.col("low").alias("low2"))
        here = F.col("more").isNotNull()
        moved = nodes.where("open").join(above, "up", "left").select(
            "id", F.when(here, F.col("up2")).otherwise(F.col("up")).alias("up"), F.coalesce("thread", "thread2", F.when(here & F.col("up2").isNull(), F.col("up"))).alias("thread"),
            (F.col("generation") + F.coalesce("more", F.lit(0))).alias("generation"), F.least("low", "low2").alias("low"), (here & F.col("up2").isNotNull()).alias("open"),
        )
        nodes = cut(moved.unionByName(nodes.where("NOT open")))
        before, left, steps = left, nodes.where("open").count(), 2 * steps
        if not left or left == before and steps >= left:
            return nodes, left


def older_paragraphs(texts: DataFrame, generations: DataFrame) -> DataFrame:
    """(parse_id, key) of unmarked paragraphs that a mail of an earlier generation of the thread has, too.

    Only hashes are shuffled. Of each thread and paragraph the earliest generation is kept, so a
    long thread makes no pairs of its mails.
    """
    own = F.transform("paragraphs", lambda p: F.struct(p["text"].alias("key"), F.lit(True).alias("own")))
    quoted = F.transform("quoted", lambda k: F.struct(k.alias("key"), F.lit(False).alias("own")))
    seen = texts.where("known").select("parse_id", F.col("mail").alias("id"), F.inline(F.array_distinct(F.concat(own, quoted))))
    placed = cut(seen.join(generations, "id").select("parse_id", "thread", "generation", "key", "own"))
    earliest = placed.groupBy("thread", "key").agg(F.min("generation").alias("earliest"), F.max("generation").alias("latest")).where("earliest < latest").select("thread", "key", "earliest")
    return placed.where("own AND generation > 0").join(earliest, ["thread", "key"]).where("generation > earliest").select("parse_id", "key")


def _small(df: DataFrame, limit: int) -> bool:
    """Whether the rows of ``df`` hold at most ``limit`` bytes as text with 16 bytes a column."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0)))).first()[0]
    return (size or 0) <= limit


def find_older_lines(parsed: DataFrame, messages: DataFrame, reduced: bool = False, broadcast_bytes: int = 24_000_000) -> DataFrame:
    """(parse_id, line_no) of every line of a body that is not newly written; with ``reduced`` (parse_id, new_text).

    ``parsed`` needs parse_id, message_id and body; ``messages`` message_id, from_email, headers_json,
    in_reply_to and thread_id. Null and empty bodies have no lines; a mail whose thread or sender is
    unknown is judged by its marks and by what many senders share. Each copy of a mail gets its own
    rows. Names, closings and matches are broadcast only if they themselves are measured to be small,
    else joined by shuffle: closings then by sender and line, so no sender's are ever gathered.
    """
    name = F.regexp_extract(F.coalesce(F.regexp_extract("headers_json", r'(?i)"from"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")), r'^\s*(?:\\")?([^<"\\]*(?:\\u[0-9a-fA-F]{4}[^<"\\]*)*)', 1)
    sender = F.xxhash64(F.lower("from_email"))
    heads = messages.where("message_id IS NOT NULL").select("message_id", F.when(F.col("from_email").isNotNull(), sender).alias("sender"), name.alias("name"), F.coalesce("in_reply_to", F.lit("")).alias("in_reply_to"))
    here = messages.where("message_id IS NOT NULL").select(F.col("message_id").alias("in_reply_to"), F.lit(False).alias("orphan")).distinct()
    heads = heads.where("in_reply_to <> ''").join(here, "in_reply_to", "left").select("message_id", "sender", "name", F.coalesce("orphan", F.lit(True)).alias("orphan")).unionByName(heads.where("in_reply_to = ''").select("message_id", "sender", "name", F.lit(False).alias("orphan")))
    senders = cut(heads.groupBy("message_id").agg(F.min(F.struct("sender", "name", "orphan")).alias("s")).select("message_id", "s.*"))
    filled = parsed.where("body IS NOT NULL AND body <> ''").select("parse_id", "message_id", "body")
    known = filled.where("message_id IS NOT NULL").join(F.broadcast(senders) if _small(senders, broadcast_bytes) else senders, "message_id", "left")
    bodies = known.unionByName(filled.where("message_id IS NULL").select("*", F.lit(None).cast("long").alias("sender"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("orphan")))

    texts = cut(own_texts(bodies))
    units = cut(closing_units(texts))
    own, shared = closing_dictionaries(units, senders)
    own = cut(own)
    older = cut(older_paragraphs(texts, thread_generations(messages)))
    gathered = older.groupBy("parse_id").agg(F.collect_set("key").alias("ancestors"))
    met = bodies.join(F.broadcast(gathered) if _small(older, broadcast_bytes) else gathered, "parse_id", "left")
    few = _small(own, broadcast_bytes)
    held: dict[int, frozenset[int]] = {}
    if few:
        by: dict[int, set[int]] = {}
        for r in own.toLocalIterator():
            by.setdefault(r["sender"], set()).add(r["key"])
        held = {k: frozenset(v) for k, v in by.items()}
        met = met.withColumn("closings", F.lit(None).cast("array<long>"))
    else:
        mine = texts.where("sender IS NOT NULL").select("parse_id", "sender", F.explode("paragraphs.keys").alias("keys")).select("parse_id", "sender", F.explode("keys").alias("key")).join(own, ["sender", "key"]).groupBy("parse_id").agg(F.collect_set("key").alias("closings"))
        met = met.join(mine, "parse_id", "left")
    dictionaries = parsed.sparkSession.sparkContext.broadcast((shared, held))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, by_sender = dictionaries.value
        for rows in batches:
            ids, found = [], []
            for i, body, sender, who, ancestors, mine in zip(*(rows[c] for c in ("parse_id", "body", "sender", "name", "ancestors", "closings")), strict=True):
                try:
                    who = json.loads(f'"{who}"') if who and "\\u" in who else who or ""
                except ValueError:
                    who = who or ""
                closings = frozenset(map(int, mine)) if mine is not None else by_sender.get(int(sender), frozenset()) if sender is not None and not pd.isna(sender) else frozenset()
                lines = older_lines(body, frozenset(map(int, ancestors)) if ancestors is not None else frozenset(), Closings(common, closings, frozenset(who.lower().replace(".", " ").split())))
                if reduced:
                    gone = set(lines)
                    lines = ["\n".join(x for k, x in enumerate(body.split("\n"), 1) if k not in gone).strip()]
                ids += [i] * len(lines)
                found += lines
            yield pd.DataFrame({"parse_id": pd.Series(ids, dtype="int64"), out: pd.Series(found, dtype="object" if reduced else "int32")})

    out = "new_text" if reduced else "line_no"
    return met.select("parse_id", "body", "sender", "name", "ancestors", "closings").mapInPandas(label, f"parse_id long, {out} {'string' if reduced else 'int'}")
