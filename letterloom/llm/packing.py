"""Filling fixed-capacity containers: best-fit decreasing with a segment tree over remaining room.

Documents are dealt to shards of some thousand containers; each shard is packed on its own, so no
task sees more than its shard. A shard wastes at most about one container,
a small share of the thousands it fills.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.session import cut


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: finds the tightest room in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, (capacity + 1).bit_length())
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_no: int) -> None:
        self.bins[room].append(bin_no)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of an open bin with the least room of ``size`` or more; None if there is none."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """Bin number of each size, largest first into the tightest open bin; sizes are within the capacity."""
    sizes = np.asarray(sizes, dtype=np.int64)
    tree, opened, out = RoomTree(capacity), 0, np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        out[i] = found[1]
        tree.add(found[0] - size, found[1])
    return out


def pack(df: DataFrame, doc_id: str, size: str, capacities: dict[str, int], bins_per_shard: int = 2000, docs_per_shard: int = 50_000) -> DataFrame:
    """Lays the documents into containers of each kind: container, shard, bin_no, doc_id, piece_no, first, size.

    A document within the capacity stays whole; a larger one is cut into full containers of its own
    (shard below 0, never packed by anyone) and a remainder that is packed like any item (``first`` is
    its first token). Null and negative sizes count as 0; empty documents lie in any container. Ids may
    repeat: each row is laid out and dealt to a shard on its own, so neither a very long document nor
    the copies of one id meet in one task. An empty table gives no rows. ``df`` is computed once.
    """
    items = cut(df.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row")))
    left = lambda c: F.when(F.col("size") <= c, F.col("size")).otherwise(F.col("size") % c)
    totals = items.agg(F.count("*").alias("docs"), *(F.coalesce(F.sum(left(c)), F.lit(0)).alias(f"c{i}") for i, c in enumerate(capacities.values()))).first()
    shards = [int(max(1, min(-(-totals[f"c{i}"] // (c * bins_per_shard)), 2**31 - 1), -(-totals["docs"] // docs_per_shard))) for i, c in enumerate(capacities.values())]
    kinds = F.array(*(F.struct(F.lit(k).alias("container"), F.lit(c).alias("capacity"), F.lit(n).alias("shards")) for (k, c), n in zip(capacities.items(), shards, strict=True)))
    each = items.select("doc_id", "size", "row", F.explode(kinds).alias("k")).select("k.*", "doc_id", "size", "row").withColumn("full", F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int"))
    alone = each.where("full > 0").select("container", "capacity", "doc_id", "row", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece_no"))
    alone = alone.select("container", (-F.col("piece_no")).alias("shard"), F.col("row").alias("bin_no"), "doc_id", "piece_no", ((F.col("piece_no") - 1).cast("long") * F.col("capacity")).alias("first"), F.col("capacity").cast("long").alias("size"))
    rest = each.withColumn("first", F.col("full").cast("long") * F.col("capacity")).withColumn("size", F.col("size") - F.col("first")).where("full = 0 OR size > 0")
    rest = rest.select("container", "capacity", F.pmod(F.xxhash64("doc_id", "row"), F.col("shards")).cast("int").alias("shard"), "doc_id", (F.col("full") + 1).alias("piece_no"), "first", "size")

    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece_no"], kind="stable")
        return rows.assign(bin_no=best_fit_decreasing(rows["size"].to_numpy(), int(rows["capacity"].iloc[0])))[["container", "shard", "bin_no", "doc_id", "piece_no", "first", "size"]]

    return rest.groupBy("container", "shard").applyInPandas(lay, "container string, shard int, bin_no long, doc_id long, piece_no int, first long, size long").unionByName(alone)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per container kind: containers used, tokens laid, share of the room that is filled."""
    bins = packed.groupBy("container", "shard", "bin_no").agg(F.sum("size").alias("size"))
    room = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])
    return bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("size").alias("tokens")).withColumn("filled", F.round(F.col("tokens") / (F.col("bins") * room[F.col("container")]), 6))
