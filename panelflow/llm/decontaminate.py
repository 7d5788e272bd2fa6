"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import stored

SHINGLE = 5  # words of a shingle
THRESHOLD = 0.8  # weighted-shingle similarity of a leak
BLOCKS, FLIPS = 8, 2  # blocks of a fingerprint, and bits by which an item's block is varied when it is filed
# Hamming distance of 64-bit fingerprints within which every item is a candidate: 23. Windows at similarity 0.8 differ
# by 9.4 bits with a deviation of 2.9, so that this is over four deviations away.
RADIUS = BLOCKS * (FLIPS + 1) - 1
BROADCAST_SHINGLES = 1_000_000  # benchmark shingles up to which they are broadcast (16 MB)


def shingles(text: Column) -> tuple[Column, Column]:
    """Lower-case words (letters and digits), and the expression of their shingle hashes given the column `_w`."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    w = F.col("_w")
    hashes = F.when(F.size(w) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])))
    return found, hashes


def fingerprints(counts: DataFrame, by: list[str]) -> DataFrame:
    """SimHash of each group of weighted shingles (h, c): by, fp, n.

    A bit is set if the shingles having it weigh more than half. Two bit counts are added up in one long, in
    32 bits each, which windows of fewer than 2 ** 32 shingles cannot overflow.
    """
    def lanes(k: int) -> Column:
        bits = [F.shiftleft(F.shiftright(F.col("h"), k + 32 * j).bitwiseAND(F.lit(1)), 32 * j) for j in range(2)]
        return F.sum((bits[0] + bits[1]) * F.col("c"))

    sums = counts.groupBy(*by).agg(*[lanes(k).alias(f"_s{k}") for k in range(32)], F.sum("c").alias("n"))
    fp = F.lit(0).cast("long")
    for k in range(32):
        for j in range(2):
            of = F.shiftrightunsigned(F.col(f"_s{k}"), 32 * j).bitwiseAND(F.lit(0xFFFFFFFF))
            fp = fp.bitwiseXOR(F.when(of * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k + 32 * j)).otherwise(F.lit(0).cast("long")))
    return sums.select(*by, fp.alias("fp"), "n")


def blocks(fp: Column) -> Column:
    """The blocks of a fingerprint: of two fingerprints within RADIUS, one block at least differs by FLIPS bits or fewer."""
    bits = 64 // BLOCKS
    return F.array(*[
        F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(fp, i * bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("v"))
        for i in range(BLOCKS)])


def around(block: Column) -> Column:
    """A block and all that differ from it by FLIPS bits or fewer."""
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << 64 // BLOCKS) if m.bit_count() <= FLIPS])
    return F.transform(masks, lambda m: F.struct(block["b"].alias("b"), block["v"].bitwiseXOR(m).alias("v")))


def window_starts(shared: DataFrame) -> DataFrame:
    """Starts of the windows worth a look: rows (_id, _tv, item, version, size, s) from the shared places (.., len, p, h).

    A window of n shingles at THRESHOLD shares at least ceil(2 T n / (1 + T)) of them; a place qualifies if so many
    shared places, itself included, lie within n (a running count at p + n - 1 less the one before p). Places too
    near the end lay the last full window. A document shorter than the item has one window, its whole text, and the
    fewer shingles it must share. Where no shared shingle repeats in the text, the count is the weighted overlap
    itself, and only the first window with the most is kept; otherwise all that qualify.
    """
    c = F.col
    by = ["_id", "_tv", "item", "version"]
    n = F.greatest(c("size") - (SHINGLE - 1), F.lit(1))
    held = F.least(n, F.greatest(c("len") - (SHINGLE - 1), F.lit(1)))
    need = F.ceil((n + held) * F.lit(THRESHOLD / (1 + THRESHOLD)) - 1e-9).cast("int")
    # the places of one text that share a shingle with one item, so bounded by the text
    one = Window.partitionBy(*by)
    numbered = shared.withColumn("_no", F.row_number().over(one.orderBy("p"))).withColumn(
        "_same", F.coalesce(F.lag("h").over(one.orderBy("h")) == c("h"), F.lit(False)))
    marks = numbered.withColumn("_repeats", F.max("_same").over(one)).select(
        *by, "size", "len", "p", "_no", "_repeats", F.inline(F.array(
            F.struct(c("p").alias("_at"), F.lit(0).alias("_ends")), F.struct((c("p") + n - 1).alias("_at"), F.lit(1).alias("_ends")))))
    upto = one.orderBy("_at", "_ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.withColumn("_n", F.sum(1 - c("_ends")).over(upto) - c("_no") + 1).where((c("_ends") == 1) & (c("_n") >= need))
    best = F.row_number().over(one.orderBy(F.desc("_n"), "p"))
    kept = counted.withColumn("_place", best).where(c("_repeats") | (c("_place") == 1))
    start = F.greatest(F.least(c("p"), c("len") - c("size")), F.lit(0))
    return kept.select(*by, "size", start.alias("s")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item it holds: id, item_id, similarity, start, n_words.

    Windows of an item's size are laid at every place of the document that has a shingle of the item and is
    followed by enough of them: a window at THRESHOLD shares 2 T / (1 + T) of its n shingles, and moved on to its first
    shared shingle it shares no fewer, so no other start need be tried, however the item's parts were moved or
    broken up. Each window gets a SimHash, and the item's blocks, filed with up to FLIPS bits changed, must hold one of its
    BLOCKS blocks, which guarantees every item within RADIUS; weighted shingle similarity (sum of the
    smaller over sum of the larger counts, at least THRESHOLD) decides. start is the first word of the best window.

    Only DataFrame operations. Benchmark shingles are counted first and broadcast up to BROADCAST_SHINGLES; beyond that the
    join is shuffled. Documents are scanned twice, the second time joined with their windows by id. The windows are
    kept as a table, so that Spark knows their size before it decides whether the texts must be shuffled to meet
    them; the texts that have windows are kept too, as both the fingerprints and the verification read them. So are the
    blocks of the items: where they are few, windows are not shuffled to meet them.

    Null and empty texts and items hold nothing. An item of fewer than SHINGLE words is one shingle, met only by a
    document of just these words. Rows that repeat an id count as one document that holds what any of
    them holds; null ids are one document. Repeated items (same id) count by each of their texts. Empty
    tables give an empty result.
    """
    found, hashed = shingles(F.col(item_text))
    # words are stored before shingles are formed of them: otherwise Spark may split a text anew for each shingle
    said = stored(
        benchmark.select(F.col(item_col).alias("item"), found.alias("_w")).filter(F.size("_w") > 0)
        .select(F.xxhash64("_w").alias("version"), "item", "_w").distinct(), "leak-benchmark"
    )
    items = said.select("version", "item", F.size("_w").alias("size"), hashed.alias("sh"))
    at_item = items.select("item", "version", "size", F.posexplode("sh").alias("q", "h"))
    item_counts = at_item.groupBy("item", "version", "size", "h").agg(F.count(F.lit(1)).alias("c"))

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    split = texts.select("_id", F.xxhash64("_t").alias("_tv"), shingles(F.col("_t"))[0].alias("_w"))
    spread = split.select("_id", "_tv", F.size("_w").alias("len"), F.posexplode(hashed).alias("p", "h"))
    known = at_item.select("h", "item", "version", "size").distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    shared = spread.join(known, "h").select("_id", "_tv", "len", "item", "version", "size", "p", "h").distinct()
    starts = stored(window_starts(shared).withColumnRenamed("_id", "_wid").withColumnRenamed("_tv", "_wtv"), "leak-starts")
    # the texts that have windows, kept as both the fingerprints and the verification read them
    having = starts.select("_wid", "_wtv").distinct()
    held = stored(texts.withColumn("_tv", F.xxhash64("_t")).join(having, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_tv") == F.col("_wtv")))
                  .dropDuplicates(["_id", "_tv"]).select("_id", "_tv", shingles(F.col("_t"))[0].alias("_w")), "leak-texts").select("_id", "_tv", hashed.alias("_sh"))
    places = starts.select("_wid", "_wtv", "size", "s").distinct()
    windows = (
        held.join(places, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_tv") == F.col("_wtv")))
        .select("_id", "_tv", "size", "s", F.explode(F.slice("_sh", F.col("s") + 1, F.greatest(F.col("size") - (SHINGLE - 1), F.lit(1)))).alias("h"))
    )
    wid = ["_id", "_tv", "size", "s"]
    counts = stored(windows.groupBy(*wid, "h").agg(F.count(F.lit(1)).alias("c")), "leak-windows")
    prints = stored(fingerprints(counts, wid), "leak-prints")
    item_prints = fingerprints(item_counts, ["item", "version", "size"]).withColumnRenamed("n", "item_n").withColumnRenamed("fp", "item_fp")

    # a window is looked up among the blocks of the items that laid it
    laid = starts.select(F.col("_wid"), F.col("_wtv"), F.col("size").alias("_wsize"), F.col("s").alias("_ws"), "item", "version").distinct()
    own = F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_tv") == F.col("_wtv")) & (F.col("size") == F.col("_wsize")) & (F.col("s") == F.col("_ws"))
    left = prints.join(laid, own).withColumn("_b", F.explode(blocks(F.col("fp")))).select(*wid, "fp", "n", "item", "version", "_b.b", "_b.v")
    filed = item_prints.withColumn("_b", F.explode(blocks(F.col("item_fp")))).withColumn("_b", F.explode(around(F.col("_b"))))
    right = stored(filed.select(F.col("item").alias("_item"), F.col("version").alias("_version"), "item_fp", "item_n", F.col("_b.b").alias("_bb"), F.col("_b.v").alias("_bv")), "leak-items")
    same_block = F.col("item").eqNullSafe(F.col("_item")) & (F.col("version") == F.col("_version")) & (F.col("b") == F.col("_bb")) & (F.col("v") == F.col("_bv"))
    near = (
        left.join(right, same_block).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        .select(*wid, "n", "item", "version", "item_n").distinct()
    )
    w = counts.withColumnsRenamed({"_id": "_cid", "_tv": "_ctv", "size": "_csize", "s": "_cs"})
    same_window = (F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_tv") == F.col("_ctv")) & (F.col("size") == F.col("_csize"))
                   & (F.col("s") == F.col("_cs")))
    mine = item_counts.select(F.col("item").alias("_item"), F.col("version").alias("_version"), F.col("h").alias("_h"), F.col("c").alias("item_c"))
    shared = (
        near.join(w, same_window)
        .join(mine, F.col("item").eqNullSafe(F.col("_item")) & (F.col("version") == F.col("_version")) & (F.col("h") == F.col("_h")))
        .groupBy(*wid, "item", "version", "n", "item_n").agg(F.sum(F.least("c", "item_c")).alias("both"))
    )
    similarity = F.col("both") / (F.col("n") + F.col("item_n") - F.col("both"))
    best = F.min(F.struct((-F.col("similarity")).alias("d"), "s", F.col("size").alias("n_words"))).alias("m")
    return (
        shared.withColumn("similarity", similarity).filter(F.col("similarity") >= THRESHOLD)
        .groupBy(F.col("_id").alias(id_col), F.col("item").alias(item_col)).agg(best)
        .select(id_col, item_col, (-F.col("m.d")).alias("similarity"), F.col("m.s").cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"))
    )
