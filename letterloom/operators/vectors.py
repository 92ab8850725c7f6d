"""Exact nearest neighbours in blocks, and hash embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block_bytes: int = 32_000_000, block: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest vectors of each query by squared distance, ties by id.

    ``queries`` has query_id and q, ``vectors`` vec_id and v. The vectors stay where they are read; the
    queries go to them in blocks of at most ``block_bytes`` (or ``block`` queries), a task keeps the k best of each query over
    all its rows, and these are merged by rank. Exact for any number of queries; no pair of rows is
    ever made. Null vectors are left out.
    """
    queries, vectors = queries.where("q IS NOT NULL"), vectors.where("v IS NOT NULL")
    count, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    blocks = max(1, -(-count // block) if block else -(-count * (8 * width + 8) // block_bytes))
    sc = queries.sparkSession.sparkContext

    def against(block: DataFrame) -> DataFrame:
        rows = block.orderBy("query_id").toArrow()
        flat = rows.column("q").combine_chunks()
        shared = sc.broadcast((rows.column("query_id").to_numpy(), flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            norms = (q * q).sum(axis=1)
            best_d, best_i = np.full((len(ids), 0), np.inf), np.full((len(ids), 0), 0, dtype=np.int64)
            for batch in batches:
                if batch.num_rows and len(ids):
                    v = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
                    own = batch.column("vec_id").to_numpy()
                    near = norms[:, None] + (v * v).sum(axis=1)[None, :] - 2 * (q @ v.T)
                    limit = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1] + 1e-6
                    d, i = list(best_d), list(best_i)
                    for j in range(len(ids)):
                        at = np.flatnonzero(near[j] <= limit[j])
                        exact = np.round(((v[at] - q[j]) ** 2).sum(axis=1), 9)
                        dd, ii = np.concatenate([d[j], exact]), np.concatenate([i[j], own[at]])
                        order = np.lexsort((ii, dd))[:k]
                        d[j], i[j] = dd[order], ii[order]
                    wide = max(map(len, d))
                    best_d = np.array([np.pad(x, (0, wide - len(x)), constant_values=np.inf) for x in d])
                    best_i = np.array([np.pad(x, (0, wide - len(x))) for x in i])
            held = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], held.shape)[held]), pa.array(best_i[held]), pa.array(best_d[held])], names=["query_id", "vec_id", "distance"])

        return vectors.select("vec_id", "v").mapInArrow(scan, "query_id long, vec_id long, distance double")

    parts = [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [against(p.select("query_id", "q")) for p in parts])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def truncated(v: Column, dim: int) -> Column:
    """The first ``dim`` numbers of a vector, at unit length again (all zeros stay so)."""
    head = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(head, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def hash_vectors(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, embedding): unit vectors of :func:`hash_cells`; texts without characters get none."""
    cells = hash_cells(texts, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b.cast("long")), F.lit(0)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return cells.select(key, F.transform(counts, lambda x: x / norm).alias("embedding"))


def hash_embedding(text: Column, dim: int) -> Column:
    """Unit vector of a text's characters and places hashed to ``dim`` cells; all zeros for none."""
    n = F.length(text)
    cells = F.when(n > 0, F.transform(F.split(text, ""), lambda c, i: F.pmod(F.ascii(c).cast("long") * F.lit(1315423911).cast("long") + i.cast("long") * F.lit(2654435761).cast("long"), F.lit(dim).cast("long"))))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.size(F.filter(cells, lambda c: c == b.cast("long"))), F.lit(0)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def hash_cells(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, cell, n): the histogram behind :func:`hash_embedding`, without holding a text's cells at once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keys, cells, ns = [], [], []
            for i, t in zip(rows[key], rows[text], strict=True):
                if t:
                    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                    h = np.bincount((codes * 1315423911 + np.arange(len(codes)) * 2654435761) % dim, minlength=dim)
                    at = np.flatnonzero(h)
                    keys += [i] * len(at)
                    cells += at.tolist()
                    ns += h[at].tolist()
            yield pd.DataFrame({key: keys, "cell": cells, "n": ns}).astype("int64")

    return texts.select(key, text).mapInPandas(count, f"{key} long, cell long, n long")
