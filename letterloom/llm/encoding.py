"""Finding and restoring text that was decoded with the wrong character encoding.

Round-trip repair: a word is re-encoded under a candidate legacy encoding and strictly decoded as
an intended one, again and again for nested layers; a step is accepted when it lowers the word's
garbling cost by a margin. The cost is learned from the whole archive, where right text far
outweighs wrong: the surprise of the character pairs around everything beyond ASCII. Spark counts
the pairs over all texts; characters outside the candidates' repertoires cost a fixed amount each, so the
table is bounded by the square of that alphabet, however large the archive.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings a text may have been wrongly decoded with, and those it may have been meant in.
LEGACY = ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "koi8-r", "cp866"]
INTENDED = ["utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "cp850", "cp437", "mac_roman"]
LAYERS = 4
#: One side of a mix-up of single-byte encodings is one of these.
_COMMON = frozenset(("cp1252", "latin-1", "cp1251"))
#: Nats by which a repair must lower the cost. Strict multi-byte decoding is strong evidence already.
MARGIN, MARGIN_UTF8, MARGIN_PER_CHANGE = 3.5, 1.0, 1.2
#: Margin of words whose edge is a typographic quote, which stands there by right more often than not.
MARGIN_QUOTED = 6.0
#: Cost of a capital after a small letter, where either is beyond ASCII, and of a character no text has.
CAPITAL_COST, HOPELESS_COST = 3.0, 4.0
#: Cost of a character outside the candidates' repertoires: as much as picking one of all there are, and a half;
#: and by how much a repair that gives such characters must lower the cost.
OTHER_COST, MARGIN_OTHER = 20.0, 12.0

_SPACE = re.compile(r"[ \t\r\n\f]+")
_HOPELESS = re.compile("[�\x80-\x84\x86-\x9f]")
_OTHER = "□"
_QUOTES = frozenset("“”„‘’«»…")


def _sloppy(wrong: str) -> dict[str, int]:
    """Byte of every character under a legacy encoding; undefined bytes stand for themselves."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(wrong)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


_BYTES = {e: _sloppy(e) for e in LEGACY}
_ALPHABET = frozenset(c for table in _BYTES.values() for c in table) | frozenset(c.lower() for table in _BYTES.values() for c in table)


def _candidates(word: str) -> Iterator[tuple[str, str, str]]:
    """(wrong, intended, repaired) for every round trip that is possible and changes the word.

    What strictly decodes as UTF-8 may be of any script; single-byte encodings only give their own.
    """
    seen = {word}
    for wrong in LEGACY:
        table = _BYTES[wrong]
        try:
            raw = bytes([table[c] for c in word])
        except KeyError:
            continue
        for intended in INTENDED:
            if intended != wrong:
                try:  # a no-break space that ended a character may have become a plain one
                    new = (raw + b"\xa0" if intended == "utf-8" and raw[-1] in b"\xc2\xc3" else raw).decode(intended)
                except UnicodeDecodeError:
                    continue
                if not new.isascii() and any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in new if c not in _ALPHABET):
                    continue
                if new not in seen and (intended == "utf-8" or (wrong in _COMMON or intended in _COMMON) and all(c < "\x80" or c in _ALPHABET for c in new)):
                    seen.add(new)
                    yield wrong, intended, new


def _pairs(word: str) -> Iterator[str]:
    """The character pairs that touch something beyond ASCII; a word of one or two characters counts whole."""
    low = word.lower().strip(".,;:!?\"'()[]<>*_-")
    if len(low) <= 2:
        if low and not low.isascii() and all(c < "\x80" or c in _ALPHABET for c in low):
            yield f"^{low}$"
        return
    padded = "^" + "".join(c if c < "\x80" or c in _ALPHABET else _OTHER for c in low) + "$"
    for a, b in pairwise(padded):
        if (a > "\x7f" or b > "\x7f") and a != _OTHER and b != _OTHER:
            yield ("0" if a.isdigit() else a) + ("0" if b.isdigit() else b)


def pair_counts(texts: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, n) over all texts of the given columns, pre-aggregated per partition."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            pairs: Counter[str] = Counter()
            for w, n in words.items():
                for p in _pairs(w):
                    pairs[p] += n
            words.clear()
            return pd.DataFrame({"pair": list(pairs), "n": list(pairs.values())}).astype({"pair": "object", "n": "int64"})

        for rows in batches:
            for c in columns:
                for t in rows[c]:
                    if t and not t.isascii():
                        words.update(w for w in _SPACE.split(t) if not w.isascii())
            if len(words) > 200_000:
                yield flush()
        yield flush()

    return texts.select(*columns).mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Repairer:
    """Repairs words under learned pair counts; results of recent words are remembered."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost_of = {p: math.log(total / n) for p, n in counts.items()}
        self.unseen = math.log(total / 0.3)
        self.known: dict[str, tuple[str, tuple[str, str] | None, bool]] = {}

    def cost(self, word: str) -> float:
        odd = sum(1 for a, b in pairwise(word) if a.islower() and b.isupper() and (a > "\x7f" or b > "\x7f"))
        other = sum(1 for c in word if c > "\x7f" and c not in _ALPHABET and c not in _QUOTES)
        return sum(self.cost_of.get(p, self.unseen) for p in _pairs(word)) + OTHER_COST * other + CAPITAL_COST * odd + HOPELESS_COST * len(_HOPELESS.findall(word))

    def word(self, word: str) -> tuple[str, tuple[str, str] | None, bool]:
        """(restored, last pair of encodings, garbled) of a word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = self._word(word)
        return found

    def _word(self, word: str) -> tuple[str, tuple[str, str] | None, bool]:
        now, cost, by = word, self.cost(word), None
        for _ in range(LAYERS):
            best = min(((self.cost(new), new, (wrong, intended)) for wrong, intended, new in _candidates(now)), default=None)
            if best is None:
                break
            changed = sum(1 for c in now if c > "\x7f")
            if cost - best[0] < (MARGIN_OTHER if any(c > "\x7f" and c not in _ALPHABET for c in best[1]) else MARGIN_UTF8 if best[2][1] == "utf-8" else max(MARGIN_QUOTED if now[0] in _QUOTES or now[-1] in _QUOTES else MARGIN, MARGIN_PER_CHANGE * changed)):
                break
            cost, now, by = best
            if now.isascii():
                break
        return now, by, by is not None or bool(_HOPELESS.search(now))

    def text(self, text: str) -> tuple[str, int, bool]:
        """(restored text, words restored, whether garbling remains)."""
        if text.isascii():
            return text, 0, False
        out, restored, left = [], 0, False
        at = 0
        for gap in [*_SPACE.finditer(text), None]:
            end = gap.start() if gap else len(text)
            w = text[at:end]
            if w and not w.isascii():
                new, by, garbled = self.word(w)
                restored += by is not None
                left |= garbled and (by is None or bool(_HOPELESS.search(new)))
                w = new
            out.append(w)
            if gap:
                out.append(gap.group())
                at = gap.end()
        return "".join(out), restored, left


def repair(texts: DataFrame, text: str, counts: dict[str, int], keep_text: bool = True) -> DataFrame:
    """Adds restored (the repaired text), restored_words and garbled_left to each row.

    A row is affected if restored_words > 0 or garbled_left. Null, empty and pure ASCII texts are
    never affected. ``counts`` is the collected :func:`pair_counts` (bounded, see the module).
    With ``keep_text`` off the texts themselves are left out of the result. No shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    rest = [f for f in texts.drop("restored", "restored_words", "garbled_left").schema if keep_text or f.name != text]
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = Repairer(shared.value)
        for rows in batches:
            done = [fix.text(t) if t else (t, 0, False) for t in rows[text]]
            out = rows[names].reset_index(drop=True)
            if keep_text:
                out["restored"] = [d[0] for d in done]
            out["restored_words"] = pd.Series([d[1] for d in done], dtype="int32")
            out["garbled_left"] = pd.Series([d[2] for d in done], dtype="bool")
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + (", restored string" if keep_text else "") + ", restored_words int, garbled_left boolean"
    return texts.mapInPandas(run, schema)
