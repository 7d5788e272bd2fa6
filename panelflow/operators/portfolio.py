"""Cohorts, retention, capped views, trades and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import attach

COHORT_LIFE = 4
# ---- fixed values: one-way cost tiers by median dollar volume (floor, bps) and flat sweep ---
COST_TIERS = [(100e6, 3.0), (25e6, 8.0), (10e6, 15.0)]
FLAT_SWEEP = [0, 5, 10, 20]


def cohort_weights(members: DataFrame, last_ord, life: int = COHORT_LIFE) -> DataFrame:
    """Book weights of overlapping equal-weight cohorts, each held for `life` captures."""
    sizes = members.groupBy("scheme", "capture_ord").agg(F.count(F.lit(1)).alias("_n"))
    held = (
        attach(members.select("scheme", "capture_ord", "ticker", "adv_usd"), sizes, ["scheme", "capture_ord"])
        .withColumn("book_ord", F.explode(F.sequence(F.col("capture_ord"), F.col("capture_ord") + life - 1)))
        .where(F.col("book_ord") <= last_ord)
    )
    return held.groupBy("scheme", "book_ord", "ticker").agg(
        F.sum(F.lit(1.0) / (F.col("_n") * life)).alias("weight"),
        F.count(F.lit(1)).alias("cohorts"),
        F.max_by("adv_usd", "capture_ord").alias("adv_usd"),
    )


def retention_band(ranked: DataFrame, share: str = "rank_share", entry: float = 0.10, life: int = COHORT_LIFE) -> DataFrame:
    """Held flag per (name, capture) under the twice-the-threshold retention rule.

    Each cohort lane re-forms every `life` captures. A stretch of in-band formations ends at the
    first out-of-band or missing one; a name is held from its first entry inside the stretch.
    """
    c = F.col
    lane = Window.partitionBy("ticker", "lane").orderBy("capture_ord")
    base = ranked.withColumn("lane", c("capture_ord") % life)
    out = ~F.coalesce(c(share) < 2 * entry, F.lit(False))
    gap = F.coalesce(F.lag("capture_ord").over(lane) != c("capture_ord") - life, F.lit(True))
    marked = base.withColumn("_out", out).withColumn("_break", (out | gap | F.coalesce(F.lag(out).over(lane), F.lit(True))))
    stretch = marked.withColumn("_stretch", F.sum(c("_break").cast("int")).over(lane))
    entered = F.coalesce(c(share) < entry, F.lit(False))
    inside = Window.partitionBy("ticker", "lane", "_stretch").orderBy("capture_ord").rowsBetween(Window.unboundedPreceding, 0)
    return stretch.withColumn("held", ~c("_out") & F.coalesce(F.bool_or(entered).over(inside), F.lit(False))).drop(
        "_out", "_break", "_stretch"
    )


def retained(band: DataFrame, enters: str, life: int = COHORT_LIFE, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows of names held at each formation of a cohort lane, from rows inside the wider band.

    `band` has the rows at which a name may stay, `enters` tells where it may also enter. Formations of a lane lie
    `life` captures apart; rows that follow each other there form an island, and a name is held from
    its first entry in the island on. A name has one row per capture.
    """
    c = F.col
    lane = Window.partitionBy(*by, "_lane").orderBy("capture_ord")
    opens = F.coalesce(c("capture_ord") - F.lag("capture_ord").over(lane) != life, F.lit(True))
    marked = band.withColumn("_lane", c("capture_ord") % life).withColumn("_island", F.sum(opens.cast("int")).over(lane))
    sofar = Window.partitionBy(*by, "_lane", "_island").orderBy("capture_ord").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_held", F.bool_or(enters).over(sofar)).where("_held").drop("_lane", "_island", "_held")


def on_trade_day(moves: DataFrame, rows: DataFrame) -> DataFrame:
    """Trades with the dollar volume of the day they are made; a name off the panel that day has none."""
    day = rows.select(F.col("capture_ord").alias("book_ord"), "ticker", "adv_usd")
    return moves.drop("adv_usd").join(day, ["book_ord", "ticker"], "left")


def capped_top(rows: DataFrame, value: str, top: int = 20, per_sector: int = 5) -> DataFrame:
    """Best `top` names with at most `per_sector` per sector.

    Both filters are row_number limits, which Spark applies inside each task before shuffling.
    """
    order = [F.desc(value), F.col("ticker")]
    w = Window.partitionBy("as_of", "_s").orderBy(*order)
    some = (
        rows.where(F.col(value).isNotNull())
        .withColumn("_s", F.coalesce("sector", F.lit("—")))
        .withColumn("_k", F.row_number().over(w))
        .where(F.col("_k") <= per_sector)
        .drop("_k", "_s")
    )
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(*order))
    return some.withColumn("place", place).where(F.col("place") <= top)


def tier_bps(adv) -> Column:
    out = F.lit(None).cast("double")
    for floor, bps in reversed(COST_TIERS):
        out = F.when(adv >= floor, F.lit(bps)).otherwise(out)
    return out


def trades(book: DataFrame, last_ord) -> DataFrame:
    """Weight change of every name at every capture; a name that drops out sells at the next one.

    A name's history is bounded by the captures, so the ordered window is too.
    """
    c = F.col
    w = Window.partitionBy("scheme", "ticker").orderBy("book_ord")
    prev = F.lag(F.struct("book_ord", "weight")).over(w)
    nxt = F.lead("book_ord").over(w)
    step = book.withColumn("_p", prev).withColumn("_n", nxt)
    before = F.when(c("_p.book_ord") == c("book_ord") - 1, c("_p.weight")).otherwise(0.0)
    now = F.struct(c("book_ord").alias("book_ord"), (c("weight") - before).alias("change"))
    exit_ = F.struct((c("book_ord") + 1).alias("book_ord"), (-c("weight")).alias("change"))
    leaves = F.coalesce(c("_n") != c("book_ord") + 1, F.lit(True)) & (c("book_ord") < last_ord)
    both = F.array_compact(F.array(now, F.when(leaves, exit_)))
    return step.select("scheme", "ticker", "adv_usd", F.inline(both)).where(F.abs("change") > 1e-12)


def costs(moves: DataFrame) -> DataFrame:
    """Turnover, tiered cost and flat-sweep costs per book; weights in fractions, costs in bps.

    A trade whose dollar volume is unknown or below every tier pays the dearest one; no trade is free.
    """
    size = F.abs("change")
    tiered = F.coalesce(tier_bps(F.col("adv_usd")), F.lit(max(bps for _, bps in COST_TIERS)))
    return moves.groupBy("scheme", "book_ord").agg(
        F.count(F.lit(1)).alias("n_trades"),
        (F.sum(size) / 2.0).alias("turnover"),
        F.sum(size * tiered).alias("tiered_bps"),
        *[F.sum(size * F.lit(float(b))).alias(f"flat_{b}_bps") for b in FLAT_SWEEP],
    )


def book_returns(book: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Weighted value, hit rate and breadth of each book."""
    joined = book.join(rows.select(F.col("capture_ord").alias("book_ord"), "ticker", value), ["book_ord", "ticker"])
    return joined.where(F.col(value).isNotNull()).groupBy("scheme", "book_ord").agg(
        (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("mean"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("names"),
    )


def diagnostics(rows: DataFrame, share: str, value: str, sub_axes: Sequence[str] = ()) -> DataFrame:
    """Top and bottom decile means, their spread and the universe mean per capture."""
    c = F.col
    top, bottom = c(share) < 0.10, c(share) >= 0.90
    return rows.where(c(value).isNotNull()).groupBy("as_of").agg(
        F.avg(F.when(top, c(value))).alias("top_mean"),
        F.avg(F.when(bottom, c(value))).alias("bottom_mean"),
        (F.avg(F.when(top, c(value))) - F.avg(F.when(bottom, c(value)))).alias("spread"),
        F.avg(value).alias("universe_mean"),
        *[F.avg(F.when(F.col(a).isNotNull(), c(value))).alias(f"{a}_mean") for a in sub_axes],
    )


def axis_attribution(rows: DataFrame, axes: dict[str, Column], value: str) -> DataFrame:
    """Mean value of the positive and negative side of each signal axis, per capture."""
    cells = F.array(*[F.struct(F.lit(n).alias("axis"), s.alias("side")) for n, s in axes.items()])
    long = rows.select("as_of", value, F.inline(cells)).where(F.col(value).isNotNull() & F.col("side").isNotNull())
    v, side = F.col(value), F.col("side")
    return long.groupBy("as_of", "axis").agg(
        F.avg(F.when(side > 0, v)).alias("positive_mean"),
        F.avg(F.when(side < 0, v)).alias("negative_mean"),
        F.count(F.lit(1)).alias("names"),
    )


def score_risers(rows: DataFrame, value: str) -> DataFrame:
    """Value by the direction of the score since the capture before."""
    w = Window.partitionBy("ticker").orderBy("capture_ord")
    p = F.lag(F.struct("capture_ord", "smart_score")).over(w)
    step = rows.withColumn("_p", p).where(F.col("_p.capture_ord") == F.col("capture_ord") - 1)
    tick = F.signum(F.col("smart_score") - F.col("_p.smart_score")).cast("int")
    return step.withColumn("score_move", tick).where(F.col("score_move").isNotNull() & F.col(value).isNotNull()).groupBy(
        "score_move"
    ).agg(F.count(F.lit(1)).alias("names"), F.avg(value).alias("mean"))


def net_returns(gross: DataFrame, cost: DataFrame) -> DataFrame:
    """Book value after tiered costs."""
    joined = gross.join(cost.select("scheme", "book_ord", "tiered_bps"), ["scheme", "book_ord"], "left")
    bps = F.coalesce("tiered_bps", F.lit(0.0))
    net = F.col("mean") - bps / 10_000.0
    return joined.select("scheme", "book_ord", F.col("mean").alias("gross"), bps.alias("cost_bps"), net.alias("net"))
