"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import stored

BLOCK_DIGITS = 3  # leading hex digits of a group key that name its block: 4,096 blocks
PROBES = 63  # capacities tried together in one round of the search
CELLS = 1024  # numbering cells of a shard


def _reach(groups: DataFrame, blocks: list[tuple], limits: list[int]) -> list[int]:
    """For each limit, the end of the last group that ends at or before it (one job).

    The driver holds the block totals only (4,096 rows at most); the job reads the blocks hit.
    """
    starts = [b[1] for b in blocks]
    ask, base = [], []
    for k, x in enumerate(limits):
        at = bisect_right(starts, x) - 1
        base.append(starts[at])
        ask.append((k, blocks[at][0], x - starts[at]))
    spark = groups.sparkSession
    wanted = sorted({a[1] for a in ask})
    probe = spark.createDataFrame(ask, "k int, block string, upto long")
    got = (
        groups.filter(F.col("block").isin(wanted)).join(F.broadcast(probe), "block")
        .filter("end <= upto").groupBy("k").agg(F.max("end").alias("end")).collect()
    )
    ends = {r.k: r.end for r in got}
    return [base[k] + ends.get(k, 0) for k in range(len(limits))]


def smallest_capacity(groups: DataFrame, blocks: list[tuple], total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """Smallest shard capacity that a greedy cut meets, and the cuts (ends of shards 0 .. shards - 2).

    A capacity of total / shards + largest always suffices, so the search range is one group wide.
    Each round tries up to PROBES capacities side by side and keeps one interval between them.
    """
    low = max(-(-total // shards), largest)
    high = low + largest
    best: list[int] | None = None
    while best is None or low < high:
        step = max(1, -(-(high - low + 1) // PROBES))
        tried = sorted({min(high, low + step * i) for i in range(PROBES)} | {high})
        at = [[0] for _ in tried]
        for _ in range(shards - 1):
            for cuts, end in zip(at, _reach(groups, blocks, [c[-1] + cap for c, cap in zip(at, tried)])):
                cuts.append(end)
        fits = [total - cuts[-1] <= cap for cuts, cap in zip(at, tried)]
        k = fits.index(True)
        best, high = at[k][1:], tried[k]
        low = tried[k - 1] + 1 if k else high
    return high, best


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot; law `bytes`.

    A group is all rows of one text and is never split; groups are ordered by the SHA-256 of the text.
    The largest shard is as small as any contiguous cut of that order allows. Since the order is by
    key, a shard is found by comparing a row's key with the cut keys: rows are not shuffled for it.
    Slots number the rows of a shard from 0 without gaps: rows are numbered inside cells (hash of the
    id), and cells are offset by the counts of the cells before, so a group holding a third of all
    rows is numbered in CELLS pieces.

    Null text counts as empty and shares a group with empty texts (size 1, crc 0). A null id takes part
    as any other; repeated rows get slots of their own, in no fixed order among themselves. An empty
    table gives an empty table; fewer groups than shards leave shards empty.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_key"),
        ), "shard-rows",
    )
    sizes = rows.groupBy("_key").agg(F.sum("size").alias("bytes")).withColumn("block", F.substring("_key", 1, BLOCK_DIGITS))
    in_block = Window.partitionBy("block").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    groups = stored(sizes.withColumn("end", F.sum("bytes").over(in_block)), "shard-groups")
    per_block = groups.groupBy("block").agg(F.max("end").alias("n"), F.max("bytes").alias("top")).orderBy("block").collect()

    blocks, total, largest = [], 0, 0
    for b in per_block:
        blocks.append((b.block, total))
        total, largest = total + b.n, max(largest, b.top)
    cut_keys: list[str] = []
    if blocks and shards > 1:
        _, cuts = smallest_capacity(groups, blocks, total, largest, shards)
        cut_keys = _keys_at(groups, blocks, cuts)
    number = F.lit(0)
    for key in cut_keys:
        number = number + (F.col("_key") > key).cast("int")
    placed = rows.withColumn("shard", number).withColumn("_cell", F.pmod(F.xxhash64("_id"), F.lit(CELLS)).cast("int"))

    cells = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_cell").orderBy("_id", "_key")
    # at most shards x CELLS rows
    numbered = placed.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "_cell"])
    return numbered.select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("_from") + F.col("_rn") - 1).cast("long").alias("slot"),
    )


def _keys_at(groups: DataFrame, blocks: list[tuple], cuts: list[int]) -> list[str]:
    """Key of the group that ends at each cut; a cut at 0 lies before every key."""
    starts = [b[1] for b in blocks]
    found = {0: ""}
    ask = []
    for x in {c for c in cuts if c > 0}:
        at = bisect_right(starts, x - 1) - 1
        ask.append((x, blocks[at][0], x - starts[at]))
    if ask:
        probe = groups.sparkSession.createDataFrame(ask, "x long, block string, end long")
        hit = groups.filter(F.col("block").isin([a[1] for a in ask])).join(F.broadcast(probe), ["block", "end"])
        found |= {r.x: r["_key"] for r in hit.select("x", "_key").collect()}
    return [found[c] for c in cuts]
