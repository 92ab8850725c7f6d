"""Repairing the text of scanned pages: split words, misread characters, running lines.

An averaged perceptron edits characters. For a word it scores to keep it or to replace, delete or
insert characters (a missing or superfluous space among them); for two neighbours whether the gap
between them is to be deleted; for a line end whether the lines are to be joined. Which replacements
scanning calls for is not listed anywhere but learned from the archive itself: rare words that differ
from frequent ones by the same few characters again and again. Examples come from undoing such edits,
tears, joints and splits made on purpose in the archive's frequent words, and from words and compounds
that are right as they are. What the perceptron sees beside the characters is how often the archive
has a word; Spark counts all words of all texts, and those that make up at least ``FLOOR`` of all
are shared, so their number is bounded by ``1 / FLOOR`` at any size of archive.

A second perceptron tells running headers and page numbers from text by a line's place on the page
and its looks, taught by the lines that come again within a text and by counted up numbers.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.session import cut

#: Texts that the perceptrons are trained on at most (documented bound; counts cover everything).
TRAINING_TEXTS = 3000
#: Examples made of each kind at most.
TRAINING_EXAMPLES = 2000
#: Least share of all words that a word must have to be shared with the workers: one in two million.
FLOOR = 5e-7
#: Share of all words from which edits may lead to a word, and from which a word serves as the target of training edits.
TARGET, FREQUENT = 2e-6, 2e-5
#: Share of the words an edit may lead to that it must be seen at, to count as a misreading.
PRODUCTIVE = 0.06

HYPHENS = "-‐‑­¬"
_EDGE = "\"'“”„«»‘’().,;:!?…[]{}*•"
_FORM = "\x0c"
_WORDS = r"(?<![\p{L}\p{N}@_])\p{L}++(?:[-'’]\p{L}++)*+(?![\p{L}\p{N}@_\x01])"
_WORD = re.compile(r"(?<![^\W_])[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: A split word: its parts are no words of their own, so they are not counted.
_SPLIT = r"[-‐‑­¬][ \t\r]*\n\f?[ \t]*[\p{L}\p{N}'’]*+"
_HEADING = re.compile(r"^\s*\d+(?:\.\d+)*[.)] +\S")
_ADDRESS = re.compile(r"@|://|/|\\|_|\.\w+\.")
_INNER = re.compile(r"([^\W\d_]{2,}[.,;:?!])([^\W\d_]+)")
_NEXT = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def word_counts(texts: DataFrame, text: str) -> dict[str, int]:
    """Words of all texts with how often they occur, under ``""`` how many words there are.

    Only words of at least ``FLOOR`` of all reach the driver, at most 1 / FLOOR of them.
    """
    whole = F.regexp_replace(F.lower(F.col(text)), _SPLIT, "\x01")
    counts = cut(texts.select(F.explode(F.regexp_extract_all(whole, F.lit(_WORDS), 0)).alias("w")).groupBy("w").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    return {"": total} | {r["w"]: r["count"] for r in counts.where(F.col("count") >= FLOOR * total).toLocalIterator()}


class Perceptron:
    """Averaged perceptron over sparse binary features, choosing among candidates."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights: dict[str, float] = weights or {}

    def score(self, features: Iterable[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def train(self, examples: list[tuple[list[list[str]], int]], rounds: int = 5) -> Perceptron:
        w: dict[str, float] = defaultdict(float)
        total: dict[str, float] = defaultdict(float)
        step = 0
        for _ in range(rounds):
            for candidates, gold in examples:
                step += 1
                scores = [sum([w[f] for f in c]) for c in candidates]
                best = scores.index(max(scores))
                if best != gold:
                    for sign, i in ((1.0, gold), (-1.0, best)):
                        for f in candidates[i]:
                            w[f] += sign
                            total[f] += sign * step
        self.weights = {f: x - total[f] / max(1, step) for f, x in w.items() if x or total[f]}
        return self


#: Kind of an edit by the lengths of what it takes away and puts in its place.
_KIND = {(1, 0): "delete", (0, 1): "insert", (1, 1): "replace", (2, 1): "merge", (1, 2): "spread"}


class Editor:
    """Edits words and line ends under word counts, learned edits and trained weights."""

    def __init__(self, counts: dict[str, int], edits: dict[str, list[str]], model: Perceptron):
        self.counts, self.edits, self.model = counts, edits, model
        self.total = max(1, counts.get("", 0))
        self.targets = {w for w, n in counts.items() if w and n >= TARGET * self.total}
        self.prefixes = {w[:i] for w in self.targets for i in range(len(w) + 1)}
        self.longest = max(map(len, self.targets), default=0)
        self.known: dict[tuple[str, bool], str | None] = {}
        self.fine: set[str] = set()
        self.scales: dict[int, int] = {}

    # --- what the archive knows
    def count(self, word: str) -> int:
        return self.counts.get(word, 0) if word else 0

    def scale(self, n: int) -> int:
        """Share of all words in half powers of ten; 0 for a word the archive hardly has."""
        s = self.scales.get(n)
        if s is None:
            s = self.scales[n] = int(2 * math.log10(n / self.total * 1e7 + 1))
        return s

    # --- one word
    def matches(self, w: str, most: int) -> list[tuple[str, tuple[tuple[int, str, str], ...]]]:
        """(word of the archive, edits) for every sequence of up to ``most`` learned edits that ends at such a word."""
        if len(w) > self.longest + most:
            return []  # no so few edits make it a word the archive has
        out, edits, prefixes, n = [], self.edits, self.prefixes, len(w)
        stack: list[tuple[int, str, tuple]] = [(0, "", ())]
        while stack:
            i, p, ops = stack.pop()
            if i == n and ops and p in self.targets:
                out.append((p, ops))
            if i < n and (q := p + w[i]) in prefixes:
                stack.append((i + 1, q, ops))
            if len(ops) < most:
                for k in (0, 1, 2):
                    if i + k <= n:
                        for put in edits.get(w[i : i + k], ()):
                            q = p + put
                            if q in prefixes:
                                stack.append((i + k, q, (*ops, (i, w[i : i + k], put))))
        return out

    def _edit(self, w: str, taken: str, put: str, i: int, m: int, n: int, was: int) -> list[str]:
        kind, edit = _KIND[len(taken), len(put)], f"{taken}>{put}"
        ratio = f"r{int(2 * math.log2(m / n))}" if n else "new"
        return [
            kind, edit, f"{edit}:<{w[i - 1] if i else '^'}", f"{edit}:>{w[i + len(taken)] if i + len(taken) < len(w) else '$'}", f"{kind}:to{self.scale(m)}", f"{kind}:was{was}",
            f"edit:to{self.scale(m)}:was{was}", f"edit:{ratio}", f"{edit}:{ratio}", f"edit:len{min(len(w), 9)}",
        ]

    def segments(self, w: str) -> list[str] | None:
        """The likeliest two or more words of the archive that the word was run together from."""
        n, get, best = len(w), self.counts.get, [(0.0, 0)] + [(math.inf, 0)] * len(w)
        if n < 4:
            return None
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                c = get(w[start:end]) if best[start][0] < math.inf and end - start < n and w[start:end] in self.targets else None
                if c:
                    cost = best[start][0] + math.log(self.total / c) + 2.0
                    if cost < best[end][0]:
                        best[end] = (cost, start)
        if best[n][0] == math.inf:
            return None
        parts, end = [], n
        while end:
            parts.append(w[best[end][1] : end])
            end = best[end][1]
        return parts[::-1]

    def _spaced(self, parts: list[str], was: int, extra: list[str]) -> list[str]:
        low, short = min(self.scale(self.count(p)) for p in parts), min(map(len, parts))
        return ["space", f"space:{min(len(parts), 4)}", f"space:low{low}", f"space:low{low}:was{was}", f"space:low{low}:short{min(short, 5)}", f"space:short{min(short, 5)}", f"space:was{was}", f"space:per{min(8, sum(map(len, parts)) // len(parts))}", *extra]

    def candidates(self, w: str, capital: bool, edge: bool) -> list[tuple[list[str], str]]:
        """Keep first, then the sequences of edits that lead to words the archive has."""
        n = self.count(w)
        was = self.scale(n)
        traits = [t for t, on in (("capital", capital), ("edge", edge), ("odd", not w.replace("-", "").replace("'", "").isalpha())) if on]
        out = [(["keep", f"keep:{was}", f"keep:len{min(len(w), 9)}", *(f"keep:{t}" for t in traits)], w)]
        found = self.matches(w, 1) or (self.matches(w, 2) if len(w) > 4 else [])
        for new, ops in {new: (new, ops) for new, ops in found}.values():
            m = self.count(new)
            if m > n:
                more = [f for i, taken, put in ops for f in self._edit(w, taken, put, i, m, n, was)]
                two = ["two", f"two:to{self.scale(m)}", f"two:len{min(len(w), 9)}", f"two:was{was}"] if len(ops) == 2 else []
                out.append(([*more, *two, *(f"edit:{t}" for t in traits)], new))
        parts = self.segments(w)
        if parts:
            out.append((self._spaced(parts, was, [f"space:{t}" for t in traits]), " ".join(parts)))
        if n < FREQUENT * self.total and len(w) >= 7 and len(w) <= 2 * self.longest + 2:  # no two words of the archive, one misread, are longer
            for at in range(3, len(w) - 2):
                for whole, rest, first in ((w[:at], w[at:], True), (w[at:], w[:at], False)):
                    if whole in self.targets:
                        for new, ((i, taken, put),) in self.matches(rest, 1):
                            m, r = self.count(new), self.count(rest)
                            if m > r:
                                two = [whole, new] if first else [new, whole]
                                out.append(([*self._spaced(two, was, []), *self._edit(rest, taken, put, i, m, r, self.scale(r)), "space+edit", *(f"space:{t}" for t in traits)], " ".join(two)))
        return out

    def word(self, w: str, capital: bool = False, edge: bool = False) -> str:
        """The word as meant (with spaces where it is several), itself if it is fine; lower case in and out."""
        ranked = self.candidates(w, capital, edge)
        if len(ranked) == 1:
            return w
        score = self.model.score
        return max(ranked, key=lambda c: score(c[0]))[1]

    def token(self, token: str, edge: bool = False) -> str | None:
        """The corrected token, or None if it is fine. ``edge``: it may be the rest of a word cut off before."""
        key = (token, edge)
        if key in self.known:
            return self.known[key]
        if len(self.known) > 300_000:
            self.known.clear()
            self.fine.clear()
        new = self.known[key] = self._token(token, edge)
        if new is None and not edge and self.solid(token):
            self.fine.add(token)
        return new

    def _token(self, token: str, edge: bool) -> str | None:
        core = token.strip(_EDGE)
        if len(core) < 3 or _ADDRESS.search(core) or sum(map(str.isalpha, core)) < 2 or core[0].isdigit() and core[1].isdigit():
            return None
        joint = _INNER.fullmatch(core)
        if joint:
            a, b = joint.groups()
            if self.model.score(self._joint(a, b)) > 0:
                return token.replace(core, f"{self.token(a) or a} {self.token(b) or b}")
            return None
        w = core.lower()
        new = self.word(w, not core[0].islower(), edge)
        if new == w and "-" in w and not self.count(w):
            new = "-".join(p if len(p) < 3 else self.word(p, not core[0].islower(), edge) for p in w.split("-"))
        return None if new == w else token.lower().replace(w, new) if core[0].islower() or core.isupper() else token.lower().replace(w, new[0].upper() + new[1:])

    def _joint(self, a: str, b: str) -> list[str]:
        low = min(self.scale(self.count(a[:-1].lower())), self.scale(self.count(b.lower())))
        return ["joint", f"joint:{a[-1]}", f"joint:low{low}", f"joint:{a[-1]}:{b[0].isupper()}", f"joint:{b[0].isupper()}:low{low}"]

    # --- gaps and line ends
    def tear(self, a: str, b: str) -> list[str]:
        """Features of deleting the gap between two words (lower case)."""
        x, y = min(8, self.scale(self.count(a))), min(8, self.scale(self.count(b)))
        return self.gap(min(8, self.scale(self.count(a + b))), min(x, y), max(x, y), min(len(a), len(b), 4))

    def gap(self, whole: int, low: int, high: int, short: int) -> list[str]:
        return ["tear", f"tear:whole{whole}", f"tear:low{low}", f"tear:whole{whole}:low{low}", f"tear:low{low}:high{high}", f"tear:short{short}", f"tear:whole{whole}:high{high}", f"tear:short{short}:low{low}"]

    def solid(self, token: str) -> bool:
        """Whether the token is frequent or no word, so that no gap beside it would ever be deleted for its sake."""
        w = token.strip(_EDGE).lower()
        return not w.isalpha() or min(8, self.scale(self.count(w))) >= self._solid

    def prepare(self) -> None:
        """Finds from the weights the share from which on words never stand beside a gap to delete."""
        top, get = 9, self.model.weights.get
        w = {n: [get(f"tear:{n}{k}", 0.0) for k in range(top)] for n in ("whole", "low", "short")}
        self._solid = 0
        for low in range(top):
            short = max(w["short"][k] + get(f"tear:short{k}:low{low}", 0.0) for k in range(1, 5))
            best = max(w["whole"][x] + get(f"tear:whole{x}:low{low}", 0.0) + max(get(f"tear:low{low}:high{y}", 0.0) + get(f"tear:whole{x}:high{y}", 0.0) for y in range(low, top)) for x in range(low, top))
            if get("tear", 0.0) + w["low"][low] + short + best > 0:
                self._solid = low + 1

    def torn(self, a: str, b: str) -> bool:
        x, y = a.lstrip(_EDGE).lower(), b.rstrip(_EDGE).lower()
        return x.isalpha() and y.isalpha() and self.count(x + y) > min(self.count(x), self.count(y)) and self.model.score(self.tear(x, y)) > 0

    def line_end(self, hyphen: str, a: str, b: str | None, upper: bool) -> list[str]:
        """Features of joining a line that ends in the word part a and a hyphen with the next one's b (lower case)."""
        head = self.scale(self.count(a.rsplit("-", 1)[-1]))
        sign = "-" if hyphen in "-‐‑" else "other"
        if b is None:
            return ["last", f"last:{sign}", f"last:head{head}", f"last:{sign}:head{head}"]
        whole, compound = self.count(a + b), self.count(f"{a}-{b}")
        if "-" in a or "-" in b or "'" in a or "'" in b:
            inner, first = a.rsplit("-", 1)[-1], b.split("-")[0]
            whole, compound = max(whole, self.count(inner + first)), max(compound, self.count(f"{inner}-{first}"), self.count(f"{a}-{first}"), self.count(f"{inner}-{b}"))
        w, c, tail = self.scale(whole), self.scale(compound), self.scale(self.count(b))
        more = "none" if whole == compound == 0 else "whole" if whole > compound else "compound"
        low = min(head, tail)
        return ["join", f"join:{sign}", f"join:{sign}:{more}", f"join:{more}", f"join:whole{w}", f"join:compound{c}", f"join:{more}:low{low}", f"join:{sign}:{more}:low{low}", f"join:head{head}:tail{tail}", f"join:upper{upper}", f"join:{more}:upper{upper}"]

    def joined(self, line: str, after: str | None) -> tuple[str, str, str] | None:
        """(first part, last token, rest) if the line ends inside a word that was split."""
        end = line.rstrip()
        if len(end) < 3 or end[-1] not in HYPHENS or not end[-2].isalpha():
            return None
        tail = end.split()[-1]
        a = tail[:-1].lstrip(_EDGE).lower()
        b = _NEXT.match(after.lstrip(_FORM + " \t")) if after is not None else None
        if after is not None and b is None:
            return None
        rest = b.group() if b else ""
        return (a, tail, rest.lower()) if self.model.score(self.line_end(end[-1], a, rest.lower() if b else None, rest[:1].isupper())) > 0 else None


# --- training
def learn_edits(counts: dict[str, int], words: Iterable[str]) -> tuple[dict[str, list[str]], dict[tuple[str, str], float], dict[str, tuple[str, tuple[str, str]]]]:
    """(edits by what they take away, their weights, explained words) from rare words that are a few characters off frequent ones."""
    total = max(1, counts.get("", 0))
    frequent = {w: n for w, n in counts.items() if len(w) >= 4 and n >= FREQUENT * total}
    holes: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for t in frequent:
        for i in range(len(t) + 1):
            for k in (0, 1, 2):
                if i + k <= len(t):
                    holes[t[:i], t[i + k :]].append((t[i : i + k], t))
    seen: dict[tuple[str, str], dict[str, str]] = defaultdict(dict)
    for w in words:
        n = counts.get(w, 0)
        for i in range(len(w) + 1):
            for k in (0, 1, 2):
                for put, t in holes.get((w[:i], w[i + k :]), ()) if i + k <= len(w) else ():
                    taken = w[i : i + k]
                    minimal = not taken or not put or taken[0] != put[0] and taken[-1] != put[-1]
                    if (len(taken), len(put)) in _KIND and taken != put and minimal and n * 10 <= frequent[t]:
                        seen[taken, put].setdefault(t, w)
    letters: Counter[str] = Counter()
    for t in frequent:
        letters.update({t[i : i + k] for i in range(len(t)) for k in (1, 2)})

    def reach(put: str) -> int:
        return letters[put] if put else len(frequent)

    kept = {e: d for e, d in seen.items() if len(d) > 2 and len(d) >= PRODUCTIVE * reach(e[1]) and (e[1] or not e[0].isalpha())}
    edits: dict[str, list[str]] = defaultdict(list)
    for taken, put in sorted(kept):
        edits[taken].append(put)
    explained = {w: (t, e) for e, d in kept.items() for t, w in d.items()}
    return dict(edits), {e: float(len(d)) for e, d in kept.items()}, explained


def train_editor(counts: dict[str, int], lines: list[str]) -> Editor:
    """An editor whose edits and weights are learned from word counts and a bounded sample of lines."""
    rng = random.Random(7)
    cores, split = set(), False
    for line in lines:
        tokens = line.split()
        for t in tokens[1:] if split else tokens:  # the rest of a split word is no word
            c = t.strip(_EDGE)
            if len(c) >= 3 and not _ADDRESS.search(c) and not _INNER.fullmatch(c) and c[-1] not in HYPHENS and not c.isdigit():
                cores.add(c)
        split = line.rstrip()[-1:] in HYPHENS
    edits, weight, explained = learn_edits(counts, sorted({c.lower() for c in cores}))
    editor = Editor(counts, edits, Perceptron())
    total = editor.total
    frequent = sorted((w for w, n in counts.items() if len(w) >= 4 and n >= FREQUENT * total), key=lambda w: (-counts[w], w))
    # A misreading is rare beside what was meant; what is more frequent than that is a word of its own.
    ratios = sorted(counts.get(w, 0) / counts[t] for w, (t, _) in explained.items())
    usual = ratios[len(ratios) // 2] if ratios else 0.0

    def misread(w: str) -> bool:
        return any(counts.get(w, 0) <= max(8 * usual * editor.count(new), 2) and editor.count(new) >= FREQUENT * total for new, _ in editor.matches(w, 1))

    examples: list[tuple[list[list[str]], int]] = []

    def add(w: str, want: str, capital: bool, edge: bool) -> None:
        cands = editor.candidates(w, capital, edge)
        gold = next((i for i, (_, new) in enumerate(cands) if new == want), None)
        if gold is not None and len(cands) > 1:
            examples.append(([f for f, _ in cands], gold))

    options = sorted(weight, key=lambda e: (-weight[e], e))
    if options and frequent:
        targets = rng.choices(frequent, weights=[math.sqrt(counts[w]) for w in frequent], k=TRAINING_EXAMPLES)
        for w in targets:  # misread on purpose, sometimes twice
            bad = w
            for _ in range(2 if rng.random() < 0.2 else 1):
                may = [(e, i) for e in options for i in range(len(bad) + 1) if bad.startswith(e[1], i) and (e[1] or 0 < i < len(bad))]
                if may:
                    (taken, put), i = rng.choices(may, weights=[weight[e] / max(1, bad.count(e[1]) if e[1] else len(bad)) for e, _ in may])[0]
                    bad = bad[:i] + taken + bad[i + len(put) :]
            if bad != w:
                add(bad, w, rng.random() < 0.15, rng.random() < 0.1)
    pairs = [(a, b) for line in rng.sample(lines, min(len(lines), 4 * TRAINING_EXAMPLES)) for a, b in zip(line.split(), line.split()[1:], strict=False)]
    rng.shuffle(pairs)
    plain = [(a.lower(), b.lower()) for a, b in pairs if a.isalpha() and b.isalpha() and editor.count(a.lower()) >= FREQUENT * total and editor.count(b.lower()) >= FREQUENT * total]
    for k, (a, b) in enumerate(plain[:TRAINING_EXAMPLES]):  # run together on purpose, three words now and then
        if k % 8 == 0 and k + 1 < len(plain) and plain[k + 1][0]:
            a, b = f"{a} {b}", plain[k + 1][0]
        add((a + b).replace(" ", ""), f"{a} {b}", False, False)
        may = [(e, i) for e in options for i in range(len(b) + 1) if e[1] and b.startswith(e[1], i)]
        if may and " " not in a and k % 2:  # and misread beside
            (taken, put), i = rng.choices(may, weights=[weight[e] for e, _ in may])[0]
            add(a + b[:i] + taken + b[i + len(put) :], f"{a} {b}", False, False)
    neighbours = {(a.lower().strip(_EDGE), b.lower().strip(_EDGE)) for line in lines for a, b in zip(line.split(), line.split()[1:], strict=False)}

    def together(w: str) -> bool:
        """Whether the word may be two neighbours run together."""
        parts = editor.segments(w)
        return parts is not None and all(p in neighbours for p in zip(parts, parts[1:], strict=False))

    right = sorted(cores)
    rng.shuffle(right)
    sure = [w for w in frequent if counts[w] >= 5 * FREQUENT * total]
    for c in right[: 3 * TRAINING_EXAMPLES] + sure[: 2 * TRAINING_EXAMPLES]:
        w = c.lower()
        share = counts.get(w, 0) / total
        if w.replace("-", "").replace("'", "").isalpha() and not misread(w) and (share >= 5 * FREQUENT or not together(w)):
            add(w, w, not c[0].islower(), False)
    for w in rng.choices(frequent or ["-"], k=TRAINING_EXAMPLES // 2):  # rests of words at the edge of a piece
        if len(w) >= 5:
            add(w[rng.randint(2, len(w) - 2) :], "", False, True)
            rest = w[rng.randint(2, len(w) - 2) :]
            add(rest, rest, False, True)
    rng.shuffle(examples)
    examples += _gap_examples(editor, plain, pairs, frequent, rng) + _end_examples(editor, lines, frequent, rng)
    editor.model.train(examples)
    editor.prepare()
    return editor


def _gap_examples(editor: Editor, plain: list[tuple[str, str]], pairs: list[tuple[str, str]], frequent: list[str], rng: random.Random) -> list[tuple[list[list[str]], int]]:
    """Two candidates each: leave (no features) and delete the gap; the same for a full stop or comma without one."""
    out: list[tuple[list[list[str]], int]] = []
    for w in rng.choices(frequent or ["-"], weights=[math.sqrt(editor.count(w)) + 1 for w in frequent or ["-"]], k=TRAINING_EXAMPLES):
        if len(w) >= 4 and w.isalpha():
            i = rng.randint(1, len(w) - 1)
            out.append(([[], editor.tear(w[:i], w[i:])], 1))
    found = 0
    for a, b in plain:
        if editor.count(a + b) > min(editor.count(a), editor.count(b)):
            out.append(([[], editor.tear(a, b)], 0))
            found += 1
            if found > TRAINING_EXAMPLES:
                break
    for a, b in plain[:TRAINING_EXAMPLES]:  # frequent words stay apart however frequent the word they might make is
        x, y = sorted((min(8, editor.scale(editor.count(a))), min(8, editor.scale(editor.count(b)))))
        out.append(([[], editor.gap(rng.randint(x, 8), x, y, min(len(a), len(b), 4))], 0))
    for a, b in pairs:
        x, y = a.lstrip(_EDGE), b.rstrip(_EDGE)
        if len(x) > 2 and len(y) > 1 and x[-1] in ".,;:?!" and x[:-1].isalpha() and y.isalpha():
            out.append(([[], editor._joint(x, y)], 1))
        elif x[:-1].isalpha() and y.isalpha() and y[0].islower() and len(out) % 3 == 0:
            out.append(([[], editor._joint(x + ".", y)], 0))  # as in the names of files and hosts
    rng.shuffle(out)
    return out[: 4 * TRAINING_EXAMPLES]


def _end_examples(editor: Editor, lines: list[str], frequent: list[str], rng: random.Random) -> list[tuple[list[list[str]], int]]:
    """Line ends split on purpose and compounds cut at their own hyphen; real ones where the counts leave no doubt."""
    out: list[tuple[list[list[str]], int]] = []
    signs = [x.rstrip()[-1] for x in lines if x.rstrip() and x.rstrip()[-1] in HYPHENS] or ["-"]
    for w in rng.choices(frequent or ["-"], k=TRAINING_EXAMPLES):
        if len(w) >= 5 and w.isalpha():
            i, sign = rng.randint(2, len(w) - 2), rng.choice(signs)
            b = w[i:] if rng.random() < 0.9 else None
            a = w[:i]
            if b and rng.random() < 0.15:  # misread inside: neither form is known
                b = b[:-1] + "¤"
            out.append(([[], editor.line_end(sign, a, b, False)], 1))
    compounds = [w for w in editor.counts if "-" in w and editor.count(w) >= FREQUENT * editor.total / 4]
    for w in rng.choices(sorted(compounds) or ["-"], k=TRAINING_EXAMPLES):
        if len(w) > 3:
            i = rng.choice([k for k, c in enumerate(w) if c == "-"])
            out.append(([[], editor.line_end("-", w[:i], w[i + 1 :] if rng.random() < 0.9 else None, rng.random() < 0.1)], 0))
    for line, after in zip(lines, lines[1:], strict=False):
        end = line.rstrip()
        b = _NEXT.match(after.lstrip(_FORM + " \t"))
        if len(end) > 2 and end[-1] in HYPHENS and end[-2].isalpha() and b:
            a = end.split()[-1][:-1].lstrip(_EDGE).lower()
            whole, compound = editor.count(a + b.group().lower()), editor.count(f"{a}-{b.group().lower()}")
            if max(whole, compound) >= 20 * min(whole, compound) and whole != compound:
                out.append(([[], editor.line_end(end[-1], a, b.group().lower(), b.group()[0].isupper())], int(whole > compound)))
    rng.shuffle(out)
    return out[: 3 * TRAINING_EXAMPLES]


# --- running lines and page numbers
@lru_cache(1 << 16)
def _shape(line: str) -> str:
    return re.sub(r"[\W\d_]+", " ", line).strip().lower()


_ROMAN = re.compile(r"^[ivxlc]+$")
_DIGITS = re.compile(r"\d+")
_GAP_NUMBER = re.compile(r"^\d+ {2,}|.* {3,}\S*\d\S*$")


def _mask(bare: str) -> str:
    return "i" if _ROMAN.match(bare) else _DIGITS.sub("9", bare)


def _alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 3:
        return False
    m = SequenceMatcher(None, a, b, False)
    return m.quick_ratio() > 0.8 and m.ratio() > 0.8


def _stop(bare: str) -> str:
    end = bare[-1]
    return "stop" if end in ".!?" else "comma" if end in ",;:" else "hyphen" if end in HYPHENS else "open"


def _looks(line: str) -> tuple:
    """A line's looks alone: title, stop, size, words, few letters, heading, gap before a number, form, first, last, numbers."""
    bare = line.strip(_FORM + " \t\r")
    words = bare.split()
    letters = [w[0].isupper() for w in words if w[0].isalpha()]
    title = "none" if not letters else "upper" if bare.isupper() else "title" if sum(letters) >= 0.75 * len(letters) else "some"
    few = min(9, sum(map(str.isalpha, bare[:24])))
    if few < 9:
        few = min(9, sum(map(str.isalpha, bare)))
    heading = bare[0].isdigit() and bool(_HEADING.match(bare))
    gap = ("   " in bare or bare[0].isdigit()) and bool(_GAP_NUMBER.match(bare))
    numbers = len(_DIGITS.findall(bare))
    form = _mask(bare) if few <= 8 and numbers or len(bare) < 6 else ""
    first = f"{_mask(words[0])}:{_mask(words[1]) if len(words) > 1 else ''}" if len(letters) < len(words) and len(words) < 9 else ""
    last = f"{words[-1].lower()}:{words[-2]}" if 2 < len(words) < 9 and not words[-2].isalnum() else ""
    return title, _stop(bare), min(len(bare) // 12, 6), min(len(words), 8), few, heading, gap, form, first, last, min(3, numbers)


def _places(lines: list[str]) -> dict[int, str]:
    """Place on its page of every line with text: first, last, beside the first or last, or within."""
    at = [i for i, x in enumerate(lines) if x.strip(_FORM + " \t\r")]
    out = {}
    for k, i in enumerate(at):
        before, after = at[k - 1] if k else None, at[k + 1] if k + 1 < len(at) else None
        starts = before is None or lines[i].startswith(_FORM) or any(lines[j].startswith(_FORM) for j in range(before + 1, i))
        ends = after is None or lines[after].startswith(_FORM) or any(lines[j].startswith(_FORM) for j in range(i + 1, after))
        alone = f"{before is not None and i - before > 1}{after is not None and after - i > 1}"
        out[i] = f"{'start' if starts else 'end' if ends else 'in'}:{alone}"
    return out


def recurring(lines: list[str]) -> dict[str, int]:
    """How often each shape of a line with letters occurs, for those that occur more than once."""
    seen = Counter(s for x in lines if not _HEADING.match(x) and len(s := _shape(x)) > 3)
    return {s: n for s, n in seen.items() if n > 1}


def counted_up(lines: list[str]) -> set[int]:
    """Lines of few letters and one number whose form comes again with a number one higher."""
    by: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, x in enumerate(lines):
        bare = x.strip(_FORM + " \t\r")
        if bare and sum(map(str.isalpha, bare)) <= 8:
            numbers = _DIGITS.findall(bare)
            value = int(numbers[0][:9]) if numbers else {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}.get(bare)
            if value is not None and not _HEADING.match(bare):
                by[_mask(bare)][value].append(i)
    return {i for values in by.values() for v, at in values.items() if v + 1 in values or v - 1 in values for i in at}


CLASSES = ("text", "header", "pageno")


class Furniture:
    """Tells running lines and page numbers from text by trained weights over place and looks."""

    def __init__(self, weights: dict[str, tuple[float, float, float]]):
        self.weights = weights
        self.cache: dict[tuple[tuple, str, str], str] = {}

    def features(self, looks: tuple, place: str, again: str) -> list[str]:
        title, stop, size, n, few, heading, gap, form, first, last, numbers = looks
        return [
            f"size:{size}", f"words:{n}", f"title:{title}", f"stop:{stop}", f"few:{few}", f"heading:{heading}", f"gap:{gap}", f"form:{form}", f"first:{first}", f"last:{last}", f"{title}:{stop}:{size}", f"{title}:{heading}:{n}",
            f"{title}:{stop}:{heading}:{gap}", f"numbers:{numbers}:{few}:{n}", f"place:{place}", f"again:{again}", f"{title}:{place}", f"{title}:{stop}:again{again}", f"few:{few}:{place.split(':')[0]}", f"heading:{heading}:{again}",
        ]

    def kind(self, looks: tuple, place: str, again: str) -> str:
        key = (looks, place, again)
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            get, a, b, c = self.weights.get, 0.0, 0.0, 0.0
            for f in self.features(looks, place, again):
                w = get(f)
                if w:
                    a, b, c = a + w[0], b + w[1], c + w[2]
            found = self.cache[key] = "text" if a >= b and a >= c else "header" if b >= c else "pageno"
        return found

    def running(self, lines: list[str], known: frozenset[str]) -> dict[int, str]:
        """Class of every line with text that is a running line or page number; ``known``: shapes of the file's running lines."""
        again = recurring(lines)
        firm = known | again.keys()
        out = {}
        for i, place in _places(lines).items():
            s = _shape(lines[i])
            mark = "known" if s in known else str(min(again.get(s, 1), 3)) if s in again else "no"
            looks = _looks(lines[i])
            kind = self.kind(looks, place, mark)
            if mark == "no" and firm and len(s) > 3 and kind == "text" and self.kind(looks, place, "near") != "text" and any(_alike(s, f) for f in firm):
                kind = self.kind(looks, place, "near")
            if kind != "text":
                out[i] = kind
        return out


def _look(line: str) -> tuple[str, ...]:
    title, stop, _, _, _, heading, _, _, first, *_ = _looks(line)
    return title, stop, heading, first


def train_furniture(texts: list[str]) -> Furniture:
    """Learns from a bounded sample of whole texts: lines that come again, numbers that count up, and the lines of other texts."""
    rng, examples = random.Random(5), []
    plain = Furniture({})
    come, again_come = Counter(), Counter()
    for t in texts:  # looks that hardly ever come again do so by chance
        lines = t.split("\n")
        again = recurring(lines)
        for x in lines:
            if x.strip(_FORM + " \t\r"):
                come[_look(x)] += 1
                again_come[_look(x)] += _shape(x) in again
    for t in texts:
        lines = t.split("\n")
        again, numbers, places = recurring(lines), counted_up(lines), _places(lines)
        heads = {i for i in places if _shape(lines[i]) in again and i not in numbers and again_come[_look(lines[i])] >= 0.15 * come[_look(lines[i])]}
        for i, place in places.items():
            s = _shape(lines[i])
            mark = str(min(again.get(s, 1), 3)) if s in again else "no"
            if i in numbers:
                gold = 2
            elif i in heads:
                gold = 1
                mark = rng.choice((mark, "no", "near", "known"))  # so that looks and place alone must do as well
            elif (heads or numbers or place.startswith(("start", "end"))) and len(lines[i].strip()) < 48 and lines[i].rstrip()[-1] not in ".,;:!?" + HYPHENS:
                continue  # may be a running line that comes only once
            else:
                gold = 0
                if rng.random() < 0.7 and not _HEADING.match(lines[i]):
                    continue
            looks = plain.features(_looks(lines[i]), place, mark)
            examples.append(([[f"{c}|{f}" for f in looks] for c in CLASSES], gold))
    rng.shuffle(examples)
    w = Perceptron().train(examples[: 12 * TRAINING_EXAMPLES]).weights
    names = {f.split("|", 1)[1] for f in w}
    return Furniture({f: tuple(w.get(f"{c}|{f}", 0.0) for c in CLASSES) for f in names})


class Pages:
    """Finds and repairs the noise of one text at a time."""

    def __init__(self, editor: Editor, furniture: Furniture):
        self.editor, self.furniture = editor, furniture

    def noise(self, text: str, known: frozenset[str] = frozenset(), piece: bool = False) -> list[tuple[int, str]]:
        """(line number, noise) of every noisy line; blank texts have none. A ``piece`` may begin inside a word."""
        lines = text.split("\n")
        furniture = self.furniture.running(lines, known)
        out = [(i + 1, kind) for i, kind in furniture.items()]
        run = [i for i, x in enumerate(lines) if i not in furniture and x.strip(_FORM + " \t\r")]
        editor, fine = self.editor, self.editor.fine
        rest, carried = "", False
        for k, i in enumerate(run):
            line = lines[i]
            tokens = line.split()
            misread = False
            if carried:  # the rest of a split word is no word of its own
                misread = rest == "misread"
                tokens = tokens[1:]
                carried, rest = False, ""
            if tokens and line.rstrip()[-1] in HYPHENS:
                split = editor.joined(line, lines[run[k + 1]] if k + 1 < len(run) else None)
                if split:
                    out.append((i + 1, "hyphen"))
                    tokens, carried = tokens[:-1], True
                    where = self._misread_part(split[0], split[2])
                    misread |= where == "first"
                    rest = "misread" if where == "second" else ""
                else:
                    tokens[-1] = tokens[-1].rstrip(HYPHENS)
            if not misread and not fine.issuperset(tokens):
                misread = any(editor.token(t, piece and k == n == 0 and t[0].islower()) is not None for n, t in enumerate(tokens) if t not in fine) or any(editor.torn(a, b) for a, b in zip(tokens, tokens[1:], strict=False) if a not in fine or b not in fine)
            if misread:
                out.append((i + 1, "ocr"))
        return out

    def _misread_part(self, a: str, b: str) -> str:
        """Which part of a split word is misread: ``first``, ``second`` or neither."""
        if not b or self.editor.count(a + b):
            return ""
        new = self.editor.word(a + b)
        if new == a + b or " " in new:
            return ""
        same = next((i for i, (x, y) in enumerate(zip(a + b, new, strict=False)) if x != y), len(new))
        return "first" if same < len(a) else "second"

    def repaired(self, text: str, known: frozenset[str] = frozenset(), piece: bool = False) -> str:
        """Continuous paragraphs: furniture gone, split words joined, lines run on, misread words set right."""
        lines = text.split("\n")
        furniture = self.furniture.running(lines, known)
        keep = [(i, x) for i, x in enumerate(lines) if i not in furniture]
        text_at = [k for k, (_, x) in enumerate(keep) if x.strip(_FORM + " \t\r")]
        paragraphs: list[list[str]] = [[]]
        glue = ""
        for n, k in enumerate(text_at):
            x = keep[k][1]
            blank = n > 0 and k - text_at[n - 1] > 1 and not any(keep[j][1].startswith(_FORM) for j in range(text_at[n - 1] + 1, k + 1))
            if (blank or _HEADING.match(x)) and paragraphs[-1] and not glue:
                paragraphs.append([])
            split = self.editor.joined(x, keep[text_at[n + 1]][1] if n + 1 < len(text_at) else None)
            raw = x.replace(_FORM, "").split()
            if glue and raw:
                raw[0] = glue + raw[0]
            glue = raw.pop().rstrip(HYPHENS) if split and raw else ""
            tokens: list[str] = []
            for m, t in enumerate(raw):
                if tokens and self.editor.torn(tokens[-1], t):
                    tokens[-1] += t
                else:
                    tokens.append(self.editor.token(t, piece and n == m == 0 and t[0].islower()) or t)
            paragraphs[-1] += tokens
        if glue:
            paragraphs[-1].append(glue)
        return "\n\n".join(" ".join(p) for p in paragraphs if p)


# --- on tables
def training_texts(texts: DataFrame, text: str) -> list[str]:
    """A bounded sample of different texts, the same for any order of rows."""
    part = int(min(1.0, 1.1 * TRAINING_TEXTS / max(1, texts.count())) * 1_000_000)
    by = F.xxhash64(text)
    few = texts.where((F.length(text) > 0) & (F.pmod(by, F.lit(1_000_000)) < part)).select(text).distinct()
    return [r[0] for r in few.orderBy(by, text).limit(TRAINING_TEXTS).collect()]


def train(files: DataFrame, texts: DataFrame, text: str = "text") -> tuple:
    """(word counts, edits, editor weights, furniture weights): counts over all ``texts``, weights from a sample of ``files``."""
    counts = word_counts(texts, text)
    sample = training_texts(files, text)
    editor = train_editor(counts, [x for t in sample for x in t.split("\n") if x.strip()])
    return counts, editor.edits, editor.model.weights, train_furniture(sample).weights


def build(model: tuple) -> Pages:
    counts, edits, weights, furniture = model
    editor = Editor(counts, edits, Perceptron(weights))
    editor.prepare()
    return Pages(editor, Furniture(furniture))


def running_shapes(texts: DataFrame, model: tuple) -> DataFrame:
    """(rec_key, shapes) of the running lines of whole texts, for the pieces cut from them."""
    shared = texts.sparkSession.sparkContext.broadcast(model[3])

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        furniture = Furniture(shared.value)
        for rows in batches:
            found = []
            for t in rows["text"]:
                lines = (t or "").split("\n")
                found.append(sorted({s for i, kind in furniture.running(lines, frozenset()).items() if kind == "header" and (s := _shape(lines[i]))}))
            yield pd.DataFrame({"rec_key": rows["rec_key"], "shapes": found})

    return texts.select("rec_key", "text").mapInPandas(shapes, "rec_key string, shapes array<string>").where("size(shapes) > 0")


def clean_pages(texts: DataFrame, model: tuple, repaired: bool = False) -> DataFrame:
    """Noise found in, or with ``repaired`` the repaired form of, the texts (field, rec_key, text, shapes, piece).

    ``shapes`` (may be null) are running lines known from the text a piece was cut from; ``piece``
    says whether the text may begin inside a word. Null and blank texts have no noise and are
    repaired to themselves. Repeated rows give repeated results; no shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = build(shared.value)
        for rows in batches:
            field, key, line, what = [], [], [], []
            for f, k, t, s, p in zip(*(rows[c] for c in ("field", "rec_key", "text", "shapes", "piece")), strict=True):
                known = frozenset(s) if s is not None else frozenset()
                if repaired:
                    found = [(0, pages.repaired(t, known, p) if t else t)]
                else:
                    found = pages.noise(t, known, p) if t else []
                for n, x in found:
                    field.append(f)
                    key.append(k)
                    line.append(n)
                    what.append(x)
            out = pd.DataFrame({"field": field, "rec_key": key, "line_no": line, "noise": what}).astype({"field": "object", "rec_key": "object", "line_no": "int32", "noise": "object"})
            yield out.drop(columns="line_no").rename(columns={"noise": "repaired"}) if repaired else out

    return texts.select("field", "rec_key", "text", "shapes", "piece").mapInPandas(run, "field string, rec_key string, " + ("repaired string" if repaired else "line_no int, noise string"))
