"""Full-text search over postings: AND matching and BM25 ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from letterloom.functions import text as T
from letterloom.session import cut, shared_folder

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, term, tf, dl): term counts over all text columns of each document, with its length.

    Each document's terms are counted where it is read, before anything is shuffled.
    """
    every = F.concat(*(T.terms(F.col(c)) for c in texts))
    return docs.select(key, every.alias("ts")).select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


class Index:
    """Postings of a corpus written once, with document frequencies and lengths; a search reads its terms only.

    The postings lie in folders by a hash of the term, and within a file in order of terms, so the
    partitions and row groups of other terms are never read. A term of a third of all documents is
    spread over ``spread`` files.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key
        self.docs, self.length = spark.read.parquet(f"{folder}/corpus").first()
        self.tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("postings", "terms")} if self.length else {}
        self.buckets = self.tables["terms"].select(F.max("buckets")).first()[0] if self.length else 1

    @staticmethod
    def build(docs: DataFrame, key: str, texts: list[str], folder: str, buckets: int = 64, spread: int = 4) -> Index:
        spark = docs.sparkSession
        every = F.concat(*(T.terms(F.col(c)) for c in texts))
        counted = docs.select(key, every.alias("ts"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        posted = counted.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))
        keyed = posted.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64(key), F.lit(spread)))
        keyed.repartition(min(buckets * spread, 4 * spark.sparkContext.defaultParallelism), "bucket", "part").drop("part").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        written = spark.read.schema(keyed.drop("part").schema).parquet(f"{folder}/postings")
        written.groupBy("term", "bucket").agg(F.count("*").alias("df")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
        counted.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/corpus")
        return Index(spark, folder, key)

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        signed = [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(t.encode(), 42) for t in terms)]  # as Spark's xxhash64
        return self.tables[name].where(F.col("bucket").isin(sorted({h % self.buckets for h in signed})) & F.col("term").isin(terms))

    def search(self, question: list[str]) -> DataFrame:
        """(key, score) of documents holding every term of ``question``; a lower score is better (BM25).

        An empty question or corpus finds nothing.
        """
        wanted = sorted(set(question))
        df = {r["term"]: r["df"] for r in self._of("terms", wanted).collect()} if wanted and self.tables else {}
        if len(df) < len(wanted) or not wanted:
            return self.spark.createDataFrame([], f"{self.key} long, score double")
        idf = {t: math.log((self.docs - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        weight = reduce(lambda c, t: c.when(F.col("term") == t, idf[t] if idf[t] > 0 else 1e-6), wanted, F.when(F.lit(False), 0.0))
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / self.length))
        hits = self._of("postings", wanted).groupBy(self.key).agg((-F.sum(part)).alias("score"), F.count("*").alias("held"))
        return hits.where(F.col("held") == len(wanted)).select(self.key, "score")


_INDEXES: dict[tuple[str, str, str], Index] = {}


def index_of(spark: SparkSession, name: str, docs: DataFrame, key: str, texts: list[str]) -> Index:
    """The index of a table's texts, built at the first call of an application and for every new state of its files."""
    at = (spark.sparkContext.applicationId, name, str(sorted(docs.inputFiles())))
    if at not in _INDEXES:
        _INDEXES[at] = Index.build(docs, key, texts, shared_folder(spark, "index"))
    return _INDEXES[at]


def search(docs: DataFrame, key: str, texts: list[str], question: list[str]) -> DataFrame:
    """One search of a corpus that is not kept: its index is written, asked once and left to the cluster to clear."""
    return Index.build(docs, key, texts, shared_folder(docs.sparkSession, "index")).search(question)


class _Questions:
    """A block of questions: their terms numbered from the rarest on, their different sets of terms in a tree.

    The tree parts the sets by their rarest term, then the next, until few are left; a document goes down only
    where it holds the term, so frequent terms are looked at after rarer ones have agreed.
    """

    LEAF = 4

    def __init__(self, vocabulary: pa.Array, df: np.ndarray, docs: int, length: float, sets: list[tuple[int, ...]], asked: list[list[int]]):
        idf = np.log((docs - df + 0.5) / (df + 0.5))
        self.vocabulary, self.length, self.sets, self.idf = vocabulary, length, sets, np.where(idf > 0, idf, 1e-6)
        self.terms, self.sizes = np.fromiter((t for s in sets for t in s), dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int64)
        self.ids, self.asked = np.array([q for a in asked for q in a], dtype=np.int64), np.array([len(a) for a in asked], dtype=np.int64)

    @cached_property
    def tree(self) -> dict[int, tuple[list, dict, list]]:
        """By rarest term: (sets that end here, (next term: node), (rest, set) of the few that are not parted further)."""
        root: tuple[list, dict, list] = ([], {}, [])
        open_ = [(root, list(range(len(self.sets))), 0)]
        while open_:
            (ends, children, leaves), members, depth = open_.pop()
            if depth and len(members) <= self.LEAF:
                leaves += [(frozenset(self.sets[m][depth:]), m) for m in members]
                continue
            by: dict[int, list[int]] = {}
            for m in members:
                if len(self.sets[m]) == depth:
                    ends.append(m)
                else:
                    by.setdefault(self.sets[m][depth], []).append(m)
            for t, some in by.items():
                children[t] = ([], {}, [])
                open_.append((children[t], some, depth + 1))
        return root[1]

    def held(self, first: int, own: set[int]) -> Iterator[int]:
        """The sets whose rarest term is ``first`` and all of whose terms are in ``own``."""
        open_ = [self.tree[first]]
        while open_:
            ends, children, leaves = open_.pop()
            yield from ends
            for rest, m in leaves:
                if rest <= own:
                    yield m
            open_ += [children[t] for t in children.keys() & own]

    def askers(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``sets``, query_id) of every question that asks one of these sets."""
        times = self.asked[sets]
        each = np.repeat(np.arange(len(sets)), times)
        return each, self.ids[np.arange(len(each)) + np.repeat((np.cumsum(self.asked) - self.asked)[sets] - (np.cumsum(times) - times), times)]

    def scores(self, rows: np.ndarray, sets: np.ndarray, code: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """BM25 of pairs of a row and a set that it holds, to nine digits; the rows' terms come as sorted codes with their counts."""
        size = self.sizes[sets]
        pair = np.repeat(np.arange(len(rows)), size)
        term = self.terms[np.arange(len(pair)) + np.repeat((np.cumsum(self.sizes) - self.sizes)[sets] - (np.cumsum(size) - size), size)]
        n = tf[np.searchsorted(code, rows[pair] * len(self.vocabulary) + term)]
        total = np.bincount(pair, self.idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[rows[pair]] / self.length)), minlength=len(rows))
        return -np.floor(total * 1e9 + 0.5) / 1e9


#: Lower case of this letter depends on what follows it.
FINAL = "Σ"
_FOLDS: dict[str, tuple[np.ndarray, str]] = {}


def _folds(spark: SparkSession) -> tuple[np.ndarray, str]:
    """Every code point as the analyzer leaves it, 0 where no term may hold it; and the letters that need their whole text.

    Spark's own functions are asked once per application, so terms are the same on both ways.
    """
    at = spark.sparkContext.applicationId
    if at not in _FOLDS:
        points = spark.range(1, 0x110000, 1, 4).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
        seen = points.select("id", T.folded(F.col("c")).alias("f")).select("id", F.when(F.length("f") == 1, F.ascii("f")).otherwise(0).alias("f"), F.length("f").alias("n"), F.col("f").rlike(T.TERM).alias("term")).where("term OR n > 1").toArrow()
        ids, f, n = (seen.column(c).to_numpy() for c in ("id", "f", "n"))
        table = np.zeros(0x110000, dtype=np.uint32)
        table[ids] = f
        _FOLDS[at] = table, FINAL + "".join(map(chr, ids[n > 1]))
    return _FOLDS[at]


def _readable(docs: DataFrame, key: str, texts: list[str], letters: str) -> DataFrame:
    """(key, text, ts): the texts as they are, or the terms of those that must be read as a whole."""
    whole = F.concat(*(T.terms(F.col(c)) for c in texts))
    odd = reduce(Column.__or__, (F.coalesce(~F.is_valid_utf8(c) | reduce(Column.__or__, (F.col(c).contains(x) for x in letters)), F.lit(False)) for c in texts))
    return docs.select(key, odd.alias("odd"), *texts).select(key, F.when(~F.col("odd"), F.concat_ws("\n", *texts)).alias("text"), F.when(F.col("odd"), whole).alias("ts"))


def _read(batch: pa.RecordBatch, key: str, folds: np.ndarray, piece_bytes: int = 4_000_000) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(keys, number of terms of each row, the rows' terms) of :func:`_readable`, piece by piece.

    A piece is cut at the characters that no term holds; its terms lie in one buffer, none is an object of its own.
    """
    listed = pc.is_valid(batch.column("ts"))
    odd, batch = batch.filter(listed), batch.filter(pc.invert(listed))
    if odd.num_rows:
        yield odd.column(key), odd.column("ts").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), odd.column("ts").flatten()
    ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + piece_bytes, side="right")))
        keys, rows = batch.column(key).slice(at, to - at), batch.column("text").slice(at, to - at).to_pylist()
        plain = np.array([t.isascii() for t in rows])
        for ascii_ in (True, False):
            mine = [t for t, p in zip(rows, plain.tolist(), strict=True) if p is ascii_]
            if mine:
                yield keys.filter(pa.array(plain == ascii_)), *_cut(mine, folds, ascii_)
        at = to


def _cut(rows: list[str], folds: np.ndarray, ascii_: bool) -> tuple[np.ndarray, pa.Array]:
    """(number of terms of each row, the rows' terms)."""
    every = "\n".join([*rows, ""])
    codes = folds[:128].astype(np.uint8)[np.frombuffer(every.encode(), dtype=np.uint8)] if ascii_ else folds[np.frombuffer(every.encode("utf-32-le"), dtype=np.uint32)]
    held = np.concatenate([[False], codes != 0])
    bounds = np.flatnonzero(held[1:] != held[:-1])
    starts, sizes = bounds[::2], bounds[1::2] - bounds[::2]
    lengths = np.diff(np.searchsorted(starts, np.cumsum(np.fromiter(map(len, rows), dtype=np.int64) + 1)), prepend=0)
    kept = codes[held[1:]]
    data = kept.tobytes()
    if not ascii_:
        data = data.decode("utf-32-le").encode()
        if len(data) > len(kept):
            width = np.ones(len(kept), dtype=np.uint8)
            for least in (0x80, 0x800, 0x10000):
                width += kept >= least
            sizes = np.add.reduceat(width, np.cumsum(sizes) - sizes, dtype=np.int64)
    return lengths, pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data))


def _counted(lengths: np.ndarray, terms: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each term or -1, row * len(vocabulary) + number in order, its count) of rows with so many terms each."""
    ids = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.repeat(np.arange(len(lengths)), lengths) * len(vocabulary) + ids
    return ids, *np.unique(code[ids >= 0], return_counts=True)


def _best(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best (set, key, score) of each set, ties by key."""
    sets, key, score = found
    order = np.lexsort((key, score, sets))
    sets = sets[order]
    kept = order[np.arange(len(sets)) - np.searchsorted(sets, sets) < k]
    return found[0][kept], key[kept], score[kept]


def search_each(docs: DataFrame, key: str, texts: list[str], questions: DataFrame, k: int | None = None, snippet: int | None = None, block_bytes: int = 32_000_000) -> DataFrame:
    """(query_id, key, score) of :func:`search` for every question (query_id, terms) at once, to nine digits.

    The documents stay where they are read; the questions go to them in blocks of at most about ``block_bytes``. A
    first pass counts the documents that hold each term of the block, a second one finds the questions that
    each document holds. No pair is made but those found. With ``k`` a task keeps the k best of each different set of terms, ties by
    key, so the k best of all are among them; with ``snippet`` each pair has a snippet of so many terms, too.
    """
    sc, pending = docs.sparkSession.sparkContext, 50_000
    table, letters = _folds(docs.sparkSession)
    d, folds, questions = _readable(docs, key, texts, letters), sc.broadcast(table), cut(questions.select("query_id", "terms").where("query_id IS NOT NULL"))
    sized = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)
    blocks = max(1, -(-(questions.agg(F.sum(sized)).first()[0] or 0) // block_bytes))
    schema = f"query_id long, {key} long, score double" + ", snippet string" * bool(snippet)

    def numbered(block: DataFrame) -> _Questions:
        asked: dict[int, set[str]] = {}
        for q, terms in zip(*(c.to_pylist() for c in block.toArrow().columns), strict=True):
            asked.setdefault(q, set()).update(terms or [])
        words = sorted({t for terms in asked.values() for t in terms})
        vocabulary = sc.broadcast(pa.array(words, pa.string()))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, rows, total = np.zeros(len(vocabulary.value), dtype=np.int64), 0, 0
            for _, lengths, terms in (x for batch in batches for x in _read(batch, key, folds.value)):
                _, code, _ = _counted(lengths, terms, vocabulary.value)
                df += np.bincount(code % max(1, len(df)), minlength=len(df))
                rows, total = rows + len(lengths), total + int(lengths.sum())
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at], pa.int64()), pa.array([rows, total, *df[at]], pa.int64())], names=["at", "n"])

        seen = d.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        n = dict(zip(seen.column("at").to_pylist(), seen.column("n").to_pylist(), strict=True))
        docs_, total, df = n.get(-2, 0), n.get(-1, 0), np.array([n.get(i, 0) for i in range(len(words))], dtype=np.int64)
        order = np.argsort(df, kind="stable")
        number = {words[i]: at for at, i in enumerate(order)}
        by: dict[tuple[int, ...], list[int]] = {}
        for q, terms in asked.items():
            at = tuple(sorted(number[t] for t in terms))
            if at and df[order[at[0]]]:  # else a term that no document holds
                by.setdefault(at, []).append(q)
        return _Questions(pa.array([words[i] for i in order], pa.string()), df[order], docs_, total / max(1, docs_), list(by), list(by.values()))

    def against(block: DataFrame) -> DataFrame:
        shared = sc.broadcast(numbered(block))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            first = np.zeros(len(q.vocabulary), dtype=bool)
            first[list(q.tree)] = True
            best, more, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
            keyed = (batch.filter(pc.is_valid(batch.column(key))) for batch in batches if q.sets)
            for own, lengths, flat in (x for batch in keyed for x in _read(batch, key, folds.value)):
                own = own.to_numpy(zero_copy_only=False)
                ids, code, tf = _counted(lengths, flat, q.vocabulary)
                ends = np.cumsum(lengths)
                row, term = np.divmod(code, len(q.vocabulary))
                starts = np.searchsorted(row, np.arange(len(lengths) + 1))
                hit = np.flatnonzero(first[term])
                rows, sets, shown, at, held = [], [], [], -1, set()
                for last, (r, t) in zip(range(1, len(hit) + 1), zip(row[hit].tolist(), term[hit].tolist(), strict=True), strict=True):
                    if r != at:
                        at, held, words, numbers = r, set(term[starts[r] : starts[r + 1]].tolist()), None, None
                    for m in q.held(t, held):
                        rows.append(r)
                        sets.append(m)
                        if snippet:
                            if words is None:
                                words, numbers = flat.slice(ends[r] - lengths[r], lengths[r]).to_pylist(), ids[ends[r] - lengths[r] : ends[r]].tolist()
                            shown.append(_snippet(words, numbers, set(q.sets[m]), snippet))
                    if rows and (last == len(hit) or len(rows) >= pending):
                        r_, s_ = np.array(rows), np.array(sets)
                        found = (s_, own[r_], q.scores(r_, s_, code, tf, lengths))
                        if k is None:
                            each, query = q.askers(s_)
                            yield pa.RecordBatch.from_arrays([pa.array(query), *(pa.array(x[each]) for x in found[1:]), *([pa.array(shown, pa.string()).take(pa.array(each))] if snippet else [])], names=["query_id", key, "score", *["snippet"] * bool(snippet)])
                        else:
                            more, waiting = [*more, found], waiting + len(s_)
                            if waiting >= max(pending, len(best[0])):
                                best, more, waiting = _best(tuple(map(np.concatenate, zip(best, *more, strict=True))), k), [], 0
                        rows, sets, shown = [], [], []
            if k is not None:
                best = _best(tuple(map(np.concatenate, zip(best, *more, strict=True))), k)
                each, query = q.askers(best[0])
                yield pa.RecordBatch.from_arrays([pa.array(query), *(pa.array(x[each]) for x in best[1:])], names=["query_id", key, "score"])

        return d.mapInArrow(scan, schema)

    parts = [questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, map(against, parts))


def _snippet(words: list[str], numbers: list[int], wanted: set[int], width: int) -> str:
    """The snippet of :func:`letterloom.functions.text.snippet` for terms that are numbered already."""
    first = next(i for i, t in enumerate(numbers) if t in wanted)
    start = max(min(first - 2, len(words) - width), 0)
    shown = " ".join(f"[{w}]" if t in wanted else w for w, t in zip(words[start : start + width], numbers[start : start + width], strict=True))
    return "…" * (start > 0) + shown + "…" * (len(words) > start + width)


def top_each(scored: DataFrame, order: list, k: int) -> DataFrame:
    """The k first of each query_id in the given order, with their rank from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best by score, ties by key, with their rank from 1."""
    best = scored.orderBy("score", key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", key)))
