"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, seeded block selection.

Each source's documents are dealt to shards and strung together in a seeded order; every
``block_tokens`` tokens begin a block, and a document belongs to the block its middle lies in. Blocks are
apportioned to the sources by highest quotients, then each source's quota to its shards the same
way, and each shard gives its blocks in seeded order, over and over up to the source's cap.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sainte_lague(weights: Mapping[str, float], seats: int, caps: Mapping[str, int]) -> dict[str, int]:
    """Seats per key by the highest quotients weight / (2 k + 1), none above its cap; ties by key.

    All but a few seats per key are given at once by the common divisor's floor, which the highest
    quotients never undercut by more than one per key; the rest goes quotient by quotient.
    """
    keys = sorted(k for k, w in weights.items() if w > 0 and caps.get(k, 0) > 0)
    seats = min(seats, sum(caps[k] for k in keys))
    given = dict.fromkeys(weights, 0)
    open_keys, left = set(keys), seats
    while open_keys and left > 4 * len(keys):  # proportional start; keys at their cap leave the rest to others
        total = sum(weights[k] for k in open_keys)
        step = {k: min(caps[k] - given[k], int(left * weights[k] / total) - 1) for k in open_keys}
        step = {k: max(0, v) for k, v in step.items()}
        if not any(step.values()):
            break
        for k, v in step.items():
            given[k] += v
        left = seats - sum(given.values())
        full = {k for k in open_keys if given[k] >= caps[k]}
        if not full:
            break
        open_keys -= full
    heap = [(-weights[k] / (2 * given[k] + 1), k) for k in keys if given[k] < caps[k]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        given[k] += 1
        left -= 1
        if given[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * given[k] + 1), k))
    return given


def mix(df: DataFrame, doc_id: str, source: str, size: str, targets: Mapping[str, tuple[float, int]], seed: int = 1, block_tokens: int | None = None, docs_per_shard: int = 20_000) -> DataFrame:
    """The documents of the mixture with how often each is taken: source, doc_id, size, copies.

    ``targets`` maps a source to (target share, most repeats). The mixture is as large as the caps
    allow at the target shares. ``block_tokens`` defaults to the size that gives every source at least
    200 blocks and its shards at least 50 each, so blocks stay small beside shards at any size of
    corpus. Documents of no target source (null included) and those with no tokens
    take no part and give no row; documents not chosen have copies 0. Repeated ids are dealt out
    each. An empty table, or a target source without documents, leaves the others' shares in
    proportion. ``df`` is read twice (totals per source, selection).
    """
    items = df.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.col(size).cast("long").alias("size")).where(F.col("source").isin(*targets) & (F.col("size") > 0))
    totals = {r["source"]: (r["docs"], r["tokens"]) for r in items.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("tokens")).collect()}
    have = {s: (w, cap) for s, (w, cap) in targets.items() if s in totals and w > 0 and cap > 0}
    schema = "source string, doc_id long, size long, copies int"
    if not have:
        return df.sparkSession.createDataFrame([], schema)
    whole = sum(w for w, _ in have.values())
    mixture = min(totals[s][1] * cap / (w / whole) for s, (w, cap) in have.items())
    shards = {s: max(1, -(-totals[s][0] // docs_per_shard)) for s in have}
    block = block_tokens or max(1, int(min(min(totals[s][1] // 200, totals[s][1] // shards[s] // 50) for s in have)))
    count = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])
    items = items.where(F.col("source").isin(*have)).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), count[F.col("source")]).cast("int"))

    blocks = items.groupBy("source", "shard").agg(F.sum("size").alias("tokens")).withColumn("blocks", F.greatest(F.round(F.col("tokens") / block), F.lit(1)).cast("long"))
    available = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}
    quotas = sainte_lague({s: w for s, (w, _) in have.items()}, int(mixture // block), {s: available[s] * have[s][1] for s in have})
    # Within a source the same: seats a shard has for certain, then the highest quotients of its next ones.
    of = lambda values: F.create_map(*[F.lit(x) for s in have for x in (s, values[s])])[F.col("source")]
    cap = F.col("blocks") * of({s: have[s][1] for s in have})
    sure = F.greatest(F.floor(F.col("blocks") * of({s: quotas[s] / available[s] for s in have})) - 1, F.lit(0)).cast("long")
    seats = blocks.withColumn("cap", cap).withColumn("sure", sure).withColumn("open", of(quotas) - F.sum("sure").over(Window.partitionBy("source")))
    nexts = seats.select("source", "shard", "blocks", "open", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("sure") + i)).alias("k"), "cap").where("k < cap")
    won = nexts.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.col("blocks") / (2 * F.col("k") + 1)), "shard", "k"))).where("place <= open").groupBy("source", "shard").agg(F.count("*").alias("won"))
    by_shard = seats.join(won, ["source", "shard"], "left").select("source", "shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"), "blocks")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        quota, n = int(rows["quota"].iloc[0]), int(rows["blocks"].iloc[0])
        rows = rows.sort_values(["order", "doc_id"], kind="stable").reset_index(drop=True)
        size = rows["size"].to_numpy()
        want = size.sum() * (quota % n) / n  # beyond whole rounds, the blocks at the beginning of the seeded string
        taken = size.cumsum() - size / 2 < want  # a document lies where its middle lies
        gap = want - size[taken].sum()
        while len(swap := np.flatnonzero(taken == (gap < 0))):  # the documents that bring the shard nearest to its quota
            best = swap[np.argmin(np.abs(size[swap] - abs(gap)))]
            if abs(size[best] - abs(gap)) >= abs(gap):
                break
            taken[best] = not taken[best]
            gap = want - size[taken].sum()
        return rows.assign(copies=(quota // n + taken).astype("int32"))[["source", "doc_id", "size", "copies"]]

    dealt = items.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", F.lit("order"))).join(by_shard, ["source", "shard"])
    return dealt.groupBy("source", "shard").applyInPandas(choose, schema)


def share_report(mixed: DataFrame, targets: Mapping[str, tuple[float, int]]) -> DataFrame:
    """Per source: target share, tokens in the mixture, share actually reached, most copies of a document."""
    per = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    want = mixed.sparkSession.createDataFrame([(s, float(w)) for s, (w, _) in targets.items()], "source string, target_share double")
    joined = want.join(per.withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(1)))), "source", "left")
    return joined.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
