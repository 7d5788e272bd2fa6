"""Cross-sectional aggregates and the view lens of one or many captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import signals as sg
from panelflow.operators.ordered import medians, ranked_values
from panelflow.schema import CONSENSUS_ORDER, MATURE_DAYS, MIN_CAPTURES, TARGET_INDICES
from panelflow.session import attach_per_capture


def liquid_only(panel: DataFrame) -> DataFrame:
    return panel.where("liquid")


def nth_latest(panel: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the n-th latest capture (1 = latest). Captures are ranked, rows are only filtered."""
    days = panel.select("as_of").distinct()
    chosen = days.withColumn("_k", F.dense_rank().over(Window.orderBy(F.desc("as_of")))).where(F.col("_k") == n)
    return panel.join(F.broadcast(chosen.drop("_k")), "as_of", "left_semi")


def consensus_mix(panel: DataFrame) -> DataFrame:
    """Label counts per capture on the fixed five-label domain, zero filled."""
    hits = [
        F.struct(F.lit(l).alias("label"), F.count_if(F.col("analyst_consensus") == l).alias("n"))
        for l in CONSENSUS_ORDER
    ]
    return (
        liquid_only(panel).groupBy("as_of").agg(F.array(*hits).alias("_m")).select("as_of", F.inline("_m"))
    )


def score_histogram(panel: DataFrame) -> DataFrame:
    """Scores rounded half to even into buckets 1..10, zero filled, others dropped."""
    whole = F.bround(F.col("smart_score"), 0).cast("int")
    hits = [F.struct(F.lit(b).alias("bucket"), F.count_if(whole == b).alias("n")) for b in range(1, 11)]
    return (
        liquid_only(panel).groupBy("as_of").agg(F.array(*hits).alias("_m")).select("as_of", F.inline("_m"))
    )


def category_counts(panel: DataFrame, field: str) -> DataFrame:
    """Counts per category, blanks dropped."""
    named = F.nullif(F.col(field), F.lit(""))
    return (
        liquid_only(panel)
        .where(named.isNotNull())
        .groupBy("as_of", named.alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stance_counts(panel: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Positive / negative / neutral counts per sentiment axis; neutral takes the remainder."""
    axes = F.inline(F.array(*[F.struct(F.lit(f).alias("axis"), F.col(f).alias("v")) for f in fields]))
    s = sg.stance(F.col("v"))
    positive, negative = F.count_if(F.col("v").rlike("(?i)positive|bullish")), F.count_if(s == "negative")
    return (
        liquid_only(panel)
        .select("as_of", axes)
        .groupBy("as_of", "axis")
        .agg(
            positive.alias("positive"),
            negative.alias("negative"),
            F.greatest(F.lit(0), F.count(F.lit(1)) - positive - negative).alias("neutral"),
        )
    )


def sector_summary(panel: DataFrame) -> DataFrame:
    return (
        liquid_only(panel)
        .groupBy("as_of", sg.sector_name(F.col("sector")).alias("sector"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("smart_score"), 2).alias("mean_ss"),
            F.round(100.0 * F.count_if(sg.is_buy(F.col("analyst_consensus"))) / F.count(F.lit(1)), 1).alias("pct_buy"),
        )
    )


def sector_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy("as_of", F.desc("n"), "sector")


def index_counts(panel: DataFrame) -> DataFrame:
    """Snapshot, matched and liquid totals with liquid members per target index."""
    ok = F.col("liquid")
    return panel.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("snapshot_total"),
        F.count_if("matched").alias("matched"),
        F.count_if(ok).alias("liquid"),
        F.count_if(ok & F.array_contains("member_of", TARGET_INDICES[0])).alias("sp500"),
        F.count_if(ok & F.array_contains("member_of", TARGET_INDICES[1])).alias("sp400"),
    )


def week_aggregates(panel: DataFrame) -> DataFrame:
    """Liquid count, percent buy-rated (of all liquid rows) and three medians per capture."""
    rows = liquid_only(panel)
    counts = rows.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("liquid"),
        F.round(100.0 * F.count_if(sg.is_buy(F.col("analyst_consensus"))) / F.count(F.lit(1)), 1).alias("pct_buy"),
    )
    mid = medians(
        rows,
        ["as_of"],
        {
            "median_upside": F.col("analyst_price_target_upside_pct"),
            "median_best_upside": F.col("best_analyst_upside_pct"),
            "median_smart_score": F.col("smart_score"),
        },
    )
    rounded = mid.select("as_of", *[F.round(c, 2).alias(c) for c in mid.columns if c != "as_of"])
    return attach_per_capture(counts, rounded)


def accrual(captures: DataFrame, today: str) -> DataFrame:
    """Captures, date range, matured ones and what is missing to a first read."""
    age = F.date_diff(F.to_date(F.lit(today)), F.col("as_of"))
    n = F.count(F.lit(1))
    return captures.agg(
        n.alias("snapshots"),
        F.min("as_of").alias("first_as_of"),
        F.max("as_of").alias("last_as_of"),
        F.count_if(age >= MATURE_DAYS).alias("matured"),
        F.greatest(F.lit(0), F.lit(MIN_CAPTURES) - n).alias("remaining"),
        (n >= MIN_CAPTURES).alias("runnable"),
    )


def panel_view(panel: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The displayed panel row with the lens gates; columns of the panel named in `carry` come along as they are.

    The price gate compares with the capture's median of values already rounded to one decimal;
    rounding also bounds the value-count buffer of the median.
    """
    rows = liquid_only(panel)
    tr = F.round("tr_3m_pct", 1)
    gate = rows.groupBy("as_of").agg(F.round(F.median(tr), 2).alias("median_tr_3m"))
    price_ok = F.coalesce(F.col("tr_3m") >= F.col("median_tr_3m"), F.lit(False))
    insider_ok = ~F.col("insider_signal").eqNullSafe(F.lit("Negative"))
    score_ok = F.col("smart_score").isNull() | (F.col("smart_score") > 4)
    view = rows.select(
        "as_of", "ticker", "sector", "smart_score", "analyst_consensus",
        F.col("analyst_price_target_upside_pct").alias("upside"),
        F.col("best_analyst_upside_pct").alias("best_upside"),
        tr.alias("tr_3m"),
        F.round("vol_ann_pct", 1).alias("vol_ann"),
        sg.target_gap(F.col("best_analyst_price_target"), F.col("analyst_price_target")).alias("bvc_gap"),
        "insider_signal", "investor_sentiment", "news_sentiment", "dividend_yield",
        F.round(F.coalesce(F.col("market_cap"), F.lit(0.0)) / 1e9, 1).alias("mktcap_b"),
        F.when(F.array_contains("member_of", TARGET_INDICES[0]), "500").otherwise("400").alias("idx"),
        *carry,
    )
    return (
        attach_per_capture(view, gate)
        .withColumn("upside_per_vol", sg.upside_per_vol(F.col("best_upside"), F.col("vol_ann")))
        .withColumn("lens_pass", price_ok & insider_ok & score_ok)
    )


def lens_counts(panel: DataFrame) -> DataFrame:
    return (
        panel_view(panel)
        .groupBy("as_of")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.first("median_tr_3m").alias("median_tr_3m"),
            F.count_if("lens_pass").alias("n_pass"),
        )
    )


def sector_percent_rank(panel: DataFrame) -> DataFrame:
    """Share of the sector's valued names strictly below, in percent; null for lone names."""
    view = panel_view(panel).select(
        "as_of", "ticker", sg.sector_name(F.col("sector")).alias("sector"), "upside_per_vol"
    )
    ranks = ranked_values(view, ["as_of", "sector"], "upside_per_vol")
    pct = F.when(
        F.col("n_total") >= 2, F.bround(100.0 * F.col("n_below") / (F.col("n_total") - 1), 0).cast("int")
    )
    return view.join(ranks, ["as_of", "sector", "upside_per_vol"], "left").select(
        "as_of", "sector", "ticker", "upside_per_vol", pct.alias("sector_pct")
    )


def sector_leaders(panel: DataFrame, top: int = 3) -> DataFrame:
    """Top names per sector by upside per volatility.

    The row_number filter is pushed below the shuffle by Spark (window group limit), so a large
    sector sends at most `top` rows per task.
    """
    view = panel_view(panel).where(F.col("upside_per_vol").isNotNull())
    w = Window.partitionBy("as_of", "sector").orderBy(F.desc("upside_per_vol"), "ticker")
    return (
        view.withColumn("sector", sg.sector_name(F.col("sector")))
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= top)
        .select("as_of", "sector", "place", "ticker", "upside_per_vol")
    )
