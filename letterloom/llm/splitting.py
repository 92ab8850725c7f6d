"""Cutting oversized texts at natural boundaries, by content-defined landmarks.

A rolling hash over the characters marks landmarks wherever its value falls into one class; a cut
snaps to the natural boundary nearest the first landmark past the minimum size. Since landmarks
depend on a few characters only, an edit moves the cuts near it and leaves the other pieces alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WINDOW = 16
_WHITE = np.array([9, 10, 12, 13, 32], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…。！？"], dtype=np.uint32)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def size_in(text: Column, unit: Column) -> Column:
    """Size of a text in ``chars`` (code points), ``utf8_bytes`` or ``words``; null text gives null."""
    words = F.size(F.filter(F.split(text, "[ \\t\\r\\n\\f]+"), lambda w: w != ""))
    return F.when(unit == "chars", F.length(text)).when(unit == "utf8_bytes", F.octet_length(text)).when(unit == "words", words)


def _landmarks(codes: np.ndarray, every: int) -> np.ndarray:
    """Positions after windows whose rolling hash falls into one of ``every`` classes."""
    if len(codes) < _WINDOW:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(len(codes) - _WINDOW + 1, dtype=np.uint64)
    for k in range(_WINDOW):
        h = h * np.uint64(31) + codes[k : len(codes) - _WINDOW + 1 + k].astype(np.uint64)
    return np.flatnonzero((h * _MULTIPLIER >> np.uint64(40)) % np.uint64(every) == 0) + _WINDOW


def cut_points(text: str, unit: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) in code points of the pieces of ``text``.

    Every piece is within ``max_size`` units; consecutive pieces share exactly ``overlap`` units
    (for bytes, the most whole characters within that many). An overlap of half the limit or more
    counts as just under half. A run without any boundary is cut at the limit.
    """
    return [(a, b) for a, b, _ in _cut(text, unit, max_size, overlap)]


def _cut(text: str, unit: str, max_size: int, overlap: int) -> list[tuple[int, int, int]]:
    """:func:`cut_points` with how many units each piece shares with the one before."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    white = np.isin(codes, _WHITE)
    starts = np.flatnonzero(~white[1:] & white[:-1]) + 1
    if unit == "chars":
        units = np.arange(n + 1)
    elif unit == "utf8_bytes":
        units = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
    else:
        begins = np.concatenate([[n > 0 and not white[0]], ~white[1:] & white[:-1]]) if n else np.empty(0, bool)
        units = np.concatenate([[0], np.cumsum(begins)])
    total = int(units[n])
    if total <= max_size:
        return [(0, n, 0)]
    overlap = max(0, min(overlap, (max_size - 1) // 2))
    room = max_size - overlap
    least = max(1, room // 3)
    # A boundary is where a word starts: after a blank line, a line end, a sentence end, or a space.
    gap = starts[:, None] - np.arange(1, 4)
    near = np.where(gap >= 0, codes[np.maximum(gap, 0)], 0)
    blank = ((near == 10).sum(axis=1) >= 2) | ((near[:, 0] == 10) & (near[:, 1] == 13) & (near[:, 2] == 10))
    ends = np.isin(near[:, 1], _STOPS) | (near[:, 0] == 10)
    ranks = [starts[blank], starts[ends | blank], starts]
    marks = _landmarks(codes, max(2, room // 3 if unit != "words" else room * 2))
    pieces, start, cut, shared = [], 0, 0, 0
    while total - units[start] > max_size:
        base = int(units[cut])
        budget = max_size if cut == 0 else room
        low = int(np.searchsorted(units, base + (least if cut else max(least, overlap + 1)), "left"))  # the first piece must hold the whole overlap
        high = int(np.searchsorted(units, base + budget, "right")) - 1
        if unit == "words":  # a cut before the next word, so that the piece ends with its white space
            high = int(starts[np.searchsorted(units[starts], base + budget, "right") - 1]) if len(starts) else high
        i = int(np.searchsorted(marks, low))
        target = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        end = 0
        for found in ranks:
            a, b = np.searchsorted(found, low), np.searchsorted(found, high, "right")
            if a < b:
                inside = found[a:b]
                end = int(inside[np.argmin(np.abs(inside - target))])
                break
        end = end or max(high, cut + 1)
        pieces.append((start, end, shared))
        cut = end
        if unit == "words":
            at = int(units[cut]) - overlap
            start = int(np.searchsorted(units, at, "right")) - 1
        else:
            start = int(np.searchsorted(units, units[cut] - overlap, "left"))
        shared = int(units[cut] - units[start])
    pieces.append((start, n, shared))
    return pieces


def split_oversized(df: DataFrame, text: str, unit: str, max_size: str, overlap: str) -> DataFrame:
    """The pieces of each row's text: all columns but the text, then piece_no (from 1), n_pieces, shared, piece.

    ``unit``, ``max_size`` and ``overlap`` name columns. ``shared`` is how many units a piece really
    has in common with the one before. Texts within the limit, and rows whose limit is null or below
    1, come out whole as one piece and never pass through Python; null texts give one null piece.
    Repeated rows give repeated pieces. Columns named piece_no, n_pieces, shared or piece are
    replaced. No shuffle and a single scan: rows are marked and cut where they are read.
    """
    added = ("piece_no", "n_pieces", "shared", "piece")
    names = [c for c in df.columns if c != text and c not in added]
    over = F.coalesce((size_in(F.col(text), F.col(unit)) > F.col(max_size)) & (F.col(max_size) > 0), F.lit(False))

    @F.pandas_udf("pieces array<string>, shared array<int>")
    def cut(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ts, us, ms, os in texts:
            pieces, shared = [], []
            for t, u, m, o in zip(ts, us, ms, os, strict=True):
                spans = _cut(t, u, int(m), 0 if pd.isna(o) else int(o)) if t is not None else None
                pieces.append([t[a:b] for a, b, _ in spans] if spans else None)
                shared.append([c for _, _, c in spans] if spans else None)
            yield pd.DataFrame({"pieces": pieces, "shared": shared})

    done = df.select(*names, text, cut(F.when(over, F.col(text)), F.col(unit), F.col(max_size), F.col(overlap)).alias("__cut"))
    pieces = F.coalesce(F.arrays_zip("__cut.pieces", "__cut.shared"), F.array(F.struct(F.col(text).alias("pieces"), F.lit(0).alias("shared"))))
    each = done.withColumn("__p", pieces).select(*names, F.size("__p").alias("n_pieces"), F.posexplode("__p").alias("__i", "__x"))
    return each.select(*names, (F.col("__i") + 1).alias("piece_no"), "n_pieces", F.col("__x.shared").alias("shared"), F.col("__x.pieces").alias("piece"))
