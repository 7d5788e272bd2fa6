"""Symbol resolution, point-in-time membership, liquidity and the merged panel.

Bars are unique per (symbol, session), so a per-symbol window is bounded by the trading
calendar; every cross-symbol step is a join or a combinable aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators.asof import asof_join
from panelflow.schema import ADV_FLOOR, PRICE_FLOOR, TARGET_INDICES

SESSIONS_PER_YEAR = 252


def spellings(ticker: Column) -> Column:
    """Candidate feed spellings in order of preference, distinct."""
    swap = lambda a, b: F.replace(ticker, F.lit(a), F.lit(b))
    forms = F.array(ticker, swap(".", "-"), swap("-", "."), swap(".", " "), swap("/", "."))
    return F.array_distinct(F.transform(forms, lambda c: F.upper(F.trim(c))))


def resolve_symbols(tickers: DataFrame, bars: DataFrame) -> DataFrame:
    """First candidate spelling that has any bar; null on a miss."""
    known = bars.select("symbol").distinct()
    hits = (
        tickers.select("ticker", F.posexplode(spellings(F.col("ticker"))).alias("pos", "symbol"))
        .join(known, "symbol")
        .groupBy("ticker")
        .agg(F.min_by("symbol", "pos").alias("feed_symbol"))
    )
    return tickers.join(hits, "ticker", "left")


def _bar_windows() -> tuple[Window, Window]:
    ordered = Window.partitionBy("symbol").orderBy("session")
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, 0)


def clean(c: Column) -> Column:
    """NaN prices become null: Spark orders NaN above every number."""
    return F.when(~F.isnan(c), c)


def dollar_volume(bars: DataFrame, window: int = 21) -> DataFrame:
    """Trailing median of close_capital x volume over the last `window` non-null products."""
    ordered, _ = _bar_windows()
    return (
        bars.withColumn("_dv", clean(F.col("close_capital")) * clean(F.col("volume")))
        .where(F.col("_dv").isNotNull())
        .withColumn("adv_usd", F.percentile("_dv", 0.5).over(ordered.rowsBetween(-(window - 1), 0)))
        .select("symbol", "session", "adv_usd")
    )


def trend(bars: DataFrame, window: int = 63, minimum: int = 40) -> DataFrame:
    """Return over `window` bars and annualised volatility of the last `window` daily returns."""
    ordered, _ = _bar_windows()
    frame = ordered.rowsBetween(-(window - 1), 0)
    base = F.lag("close", window).over(ordered)
    return (
        bars.withColumn("close", clean(F.col("close")))
        .where(F.col("close").isNotNull())
        .withColumn("_ret", F.try_divide(F.col("close"), F.lag("close").over(ordered)) - 1.0)
        .withColumn("tr_3m_pct", F.when(base > 0, (F.col("close") / base - 1.0) * 100.0))
        .withColumn(
            "vol_ann_pct",
            F.when(
                F.count("_ret").over(frame) >= minimum,
                F.stddev_samp("_ret").over(frame) * F.lit(SESSIONS_PER_YEAR**0.5) * 100.0,
            ),
        )
        .select("symbol", "session", "tr_3m_pct", "vol_ann_pct")
    )


def bar_statistics(bars: DataFrame) -> DataFrame:
    """Close, trailing dollar volume, 63-bar return and volatility per bar; one sort per symbol.

    Null products and null closes do not take a place in their windows, hence the per-series
    inputs of `dollar_volume` and `trend`; they meet again on the bar key.
    """
    plain = bars.select("symbol", "session", clean(F.col("close")).alias("close_tr"))
    return plain.join(dollar_volume(bars), ["symbol", "session"], "left").join(
        trend(bars), ["symbol", "session"], "left"
    )


def liquidity_asof(anchors: DataFrame, bars: DataFrame) -> DataFrame:
    """Bar statistics at the last bar at or before `as_of`.

    Dollar volume carries forward over bars without a product. Return and volatility are those of the
    last bar with a close, null where they are null there: an older value never stands in. Bars of
    symbols without an anchor and those after a symbol's last anchor are left out first.
    """
    _, upto = _bar_windows()
    until = anchors.groupBy("symbol").agg(F.max("as_of").alias("_until"))
    wanted = bars.join(until, "symbol").where("session <= _until").drop("_until")
    closed = F.when(F.col("close_tr").isNotNull(), F.struct("tr_3m_pct", "vol_ann_pct"))
    held = bar_statistics(wanted).select(
        "symbol",
        "session",
        "close_tr",
        F.last("adv_usd", ignorenulls=True).over(upto).alias("adv_usd"),
        F.last(closed, ignorenulls=True).over(upto).alias("_closed"),
    ).select("symbol", "session", "close_tr", "adv_usd", "_closed.tr_3m_pct", "_closed.vol_ann_pct")
    return asof_join(
        anchors,
        held.withColumn("anchor_date", F.col("session")),
        ["symbol"],
        "as_of",
        "session",
        ["anchor_date", "close_tr", "adv_usd", "tr_3m_pct", "vol_ann_pct"],
    )


def members_asof(
    anchors: DataFrame, membership: DataFrame, indices: Sequence[str] = TARGET_INDICES, strict: bool = False
) -> DataFrame:
    """Target indices of which the symbol is a member at `as_of`, in index order."""
    listed = F.array(*[F.lit(i) for i in indices])
    probes = anchors.select("symbol", "as_of").distinct().withColumn("index_name", F.explode(listed))
    listed_days = membership.where(F.col("index_name").isin(*indices))
    hit = asof_join(
        probes, listed_days, ["symbol", "index_name"], "as_of", "session", ["is_member"], strict=strict
    ).where(F.col("is_member") == 1)
    ranked = F.array_sort(
        F.collect_list(F.struct((F.array_position(listed, F.col("index_name"))).alias("k"), "index_name"))
    )
    return hit.groupBy("symbol", "as_of").agg(F.transform(ranked, lambda s: s["index_name"]).alias("member_of"))


def merge_panel(
    snapshot: DataFrame,
    bars: DataFrame,
    membership: DataFrame,
    indices: Sequence[str] = TARGET_INDICES,
    price_floor: float = PRICE_FLOOR,
    adv_floor: float = ADV_FLOOR,
) -> DataFrame:
    """Snapshot rows with symbol, membership, liquidity and the universe flags; misses are kept."""
    resolved = resolve_symbols(snapshot.select("ticker").distinct(), bars)
    rows = snapshot.join(resolved, "ticker")
    anchors = rows.where("feed_symbol IS NOT NULL").select(F.col("feed_symbol").alias("symbol"), "as_of").distinct()
    stats = liquidity_asof(anchors, bars).join(members_asof(anchors, membership, indices), ["symbol", "as_of"], "left")
    stats = stats.withColumnRenamed("symbol", "feed_symbol")
    in_universe = F.size("member_of") > 0
    return (
        rows.join(stats, ["feed_symbol", "as_of"], "left")
        .withColumn("matched", F.col("feed_symbol").isNotNull())
        .withColumn("member_of", F.coalesce("member_of", F.array().cast("array<string>")))
        .withColumn("in_universe", F.col("matched") & in_universe)
        .withColumn(
            "liquid",
            F.col("in_universe")
            & F.coalesce(F.col("close_tr") >= price_floor, F.lit(False))
            & F.coalesce(F.col("adv_usd") >= adv_floor, F.lit(False)),
        )
    )


def funnel(panel: DataFrame) -> DataFrame:
    return panel.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("snapshot"),
        F.count_if("matched").alias("matched"),
        F.count_if("in_universe").alias("in_universe"),
        F.count_if("liquid").alias("liquid"),
    )


def chart_history(bars: DataFrame, as_of: str | None = None, keep: int = 262) -> DataFrame:
    """Last `keep` closes per symbol with 50 and 200 bar averages taken before truncation."""
    ordered, _ = _bar_windows()
    rows = bars.withColumn("close", clean(F.col("close"))).where(F.col("close").isNotNull())
    if as_of is not None:
        rows = rows.where(F.col("session") <= F.to_date(F.lit(as_of)))

    def average(n: int) -> Column:
        frame = ordered.rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(frame) == n, F.round(F.avg("close").over(frame), 2))

    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    return (
        rows.select(
            "symbol", "session", F.round("close", 2).alias("close"),
            average(50).alias("ma50"), average(200).alias("ma200"), newest.alias("_k"),
        )
        .where(F.col("_k") <= keep)
        .drop("_k")
    )
