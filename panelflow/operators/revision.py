"""Capture-to-capture revision: adjacent-capture diff, scoring, churn, breadth, weekly series.

A panel holds one row per (ticker, capture), so a window over a ticker is bounded by the number
of captures; everything across tickers is a combinable aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import signals as sg
from panelflow.operators import crosssection
from panelflow.session import attach_per_capture

CARRIED = [
    "liquid", "analyst_consensus", "best_analyst_price_target", "analyst_price_target",
    "smart_score", "insider_signal", "news_sentiment",
]


def adjacent(panel: DataFrame) -> DataFrame:
    """Every panel row with its own record at the previous and next capture, if adjacent.

    Adjacency is by capture ordinal: a ticker missing from the capture before has no `p`.
    """
    w = Window.partitionBy("ticker").orderBy("capture_ord")
    carried = [c for c in CARRIED if c in panel.columns]
    here = F.struct("capture_ord", *carried)
    nxt = F.struct("capture_ord", "liquid", *[c for c in ("matched",) if c in panel.columns])
    step = panel.withColumn("p", F.lag(here).over(w)).withColumn("n", F.lead(nxt).over(w))
    return step.withColumn(
        "p", F.when(F.col("p.capture_ord") == F.col("capture_ord") - 1, F.col("p"))
    ).withColumn("n", F.when(F.col("n.capture_ord") == F.col("capture_ord") + 1, F.col("n")))


def _paired() -> Column:
    return F.coalesce(F.col("liquid") & F.col("p.liquid"), F.lit(False))


def _confirmed() -> Column:
    return sg.within(F.col("rating_date"), F.col("prev_as_of"), F.col("as_of"))


def _direction() -> Column:
    return sg.label_direction(F.col("p.analyst_consensus"), F.col("analyst_consensus"))


def _move(field: str) -> Column:
    return sg.target_move(F.col(f"p.{field}"), F.col(field))


def pair_rows(panel: DataFrame) -> DataFrame:
    """Names liquid at both adjacent captures, with every change measure.

    Adjacency is by ordinal, so a row that is not liquid leaves a gap whether it is there or not; only liquid ones are sent.
    """
    now, prev = F.col("smart_score"), F.col("p.smart_score")
    return (
        adjacent(crosssection.liquid_only(panel))
        .where(_paired())
        .select(
            "as_of", "prev_as_of", "capture_ord", "ticker", "sector", "rating_date",
            F.col("p.analyst_consensus").alias("prev_cons"),
            F.col("analyst_consensus").alias("now_cons"),
            _direction().alias("dir"),
            _confirmed().alias("confirmed"),
            F.col("p.best_analyst_price_target").alias("bt_prev"),
            F.col("best_analyst_price_target").alias("bt_now"),
            _move("best_analyst_price_target").alias("bt_pct"),
            _move("analyst_price_target").alias("ct_pct"),
            prev.alias("ss_prev"),
            now.alias("ss_now"),
            F.when(now != prev, now - prev).alias("ss_d"),
            F.col("p.insider_signal").alias("ins_prev"),
            F.col("insider_signal").alias("ins_now"),
            sg.changed(F.col("p.insider_signal"), F.col("insider_signal")).alias("ins_flip"),
            F.col("p.news_sentiment").alias("news_prev"),
            F.col("news_sentiment").alias("news_now"),
            sg.changed(F.col("p.news_sentiment"), F.col("news_sentiment")).alias("news_flip"),
        )
    )


def emitted() -> Column:
    """A row is shown on a label, best-target, score or categorical change."""
    return (
        (F.col("dir") != 0)
        | F.col("bt_pct").isNotNull()
        | F.col("ss_d").isNotNull()
        | F.col("ins_flip")
        | F.col("news_flip")
    )


def _note() -> Column:
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    arrow = lambda head, a, b: F.concat(F.lit(head), dash(a), F.lit(" → "), dash(b))
    plus = lambda c: F.when(c >= 0, "+").otherwise("")
    move, tick = F.col("bt_pct"), F.col("ss_d")
    return F.concat_ws(
        " · ",
        F.when(
            F.col("dir") != 0,
            F.concat(
                "prev_cons", F.lit(" → "), "now_cons",
                F.when(F.col("confirmed"), " (confirmed in window)").otherwise(" (no rating date in window)"),
            ),
        ),
        F.when(move.isNotNull(), F.concat(F.lit("best target "), plus(move), move.cast("string"), F.lit("%"))),
        F.when(tick.isNotNull(), F.concat(F.lit("Smart Score "), plus(tick), sg.plain_number(tick))),
        F.when(F.col("ins_flip"), arrow("insider ", "ins_prev", "ins_now")),
        F.when(F.col("news_flip"), arrow("news ", "news_prev", "news_now")),
    )


def revision_rows(panel: DataFrame) -> DataFrame:
    """Scored revision rows with badge and note."""
    score = sg.action_score(F.col("dir"), F.col("confirmed"), F.col("bt_pct"), F.col("ss_d"))
    shown = lambda flag, c: F.when(F.col(flag), F.col(c)).alias(c)
    return (
        pair_rows(panel)
        .where(emitted())
        .withColumn("rev_rank", score)
        .withColumn("rev_badge", sg.badge(F.col("rev_rank")))
        .withColumn("rev_note", _note())
        .select(
            "as_of", "prev_as_of", "ticker", "sector", "prev_cons", "now_cons", "dir", "confirmed",
            "rating_date", "bt_prev", "bt_now", "bt_pct", "ct_pct", "ss_prev", "ss_now", "ss_d",
            shown("ins_flip", "ins_prev"), shown("ins_flip", "ins_now"),
            shown("news_flip", "news_prev"), shown("news_flip", "news_now"),
            "rev_rank", "rev_badge", "rev_note",
        )
    )


def panel_order(rows: DataFrame) -> DataFrame:
    """Default display order: strongest action score first."""
    return rows.orderBy(F.desc("rev_rank"), "ticker")


def with_lens(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """Back-fill the view lens into revision rows.

    Revision rows lie by ticker since they were paired, and a join by capture and ticker would move them all again. So the
    lens comes as one row per name, its captures in a list bounded by the calendar, and a row takes those of its capture.
    """
    lens = crosssection.panel_view(panel).groupBy("ticker").agg(
        F.collect_list(F.struct("as_of", "lens_pass", "upside_per_vol")).alias("_lens")
    )
    here = F.filter("_lens", lambda s: s["as_of"] == F.col("as_of"))
    others = [c for c in rows.columns if c not in ("as_of", "ticker")]
    return (
        rows.join(lens.hint("merge"), "ticker", "left")
        .withColumn("_lens", F.explode_outer(here))
        .select("as_of", "ticker", *others, "_lens.lens_pass", "_lens.upside_per_vol")
    )


def pair_counts(panel: DataFrame) -> DataFrame:
    """One row per window: pairs, label and target moves, confirmations, medians, churn.

    A row serves the window it closes and, as a possible leaver, the window it opens; both
    contributions go through one combinable aggregate. Moves are rounded to two decimals, so
    the value-count buffers behind the medians stay small whatever the number of names.
    """
    liquid = F.coalesce(F.col("liquid"), F.lit(False))
    move, confirmed, direction = _move("best_analyst_price_target"), _confirmed(), _direction()
    closes = F.struct(
        F.col("prev_as_of").alias("prev_as_of"),
        F.col("as_of").alias("as_of"),
        _paired().alias("paired"),
        F.when(_paired(), direction).otherwise(0).alias("dir"),
        F.when(_paired(), move).alias("move"),
        confirmed.alias("confirmed"),
        (liquid & ~_paired()).alias("entered"),
        F.lit(False).alias("left"),
    )
    no = F.lit(False)
    opens = F.struct(
        F.col("as_of").alias("prev_as_of"),
        F.col("next_as_of").alias("as_of"),
        no.alias("paired"),
        F.lit(0).alias("dir"),
        F.lit(None).cast("double").alias("move"),
        no.alias("confirmed"),
        no.alias("entered"),
        (liquid & ~F.coalesce(F.col("n.liquid"), F.lit(False))).alias("left"),
    )
    c = F.col
    return (
        adjacent(panel)
        .select(F.inline(F.array(closes, opens)))
        .where(c("prev_as_of").isNotNull() & c("as_of").isNotNull())
        .groupBy("prev_as_of", "as_of")
        .agg(
            F.count_if("paired").alias("pairs"),
            F.count_if(c("dir") > 0).alias("upgrades"),
            F.count_if(c("dir") < 0).alias("downgrades"),
            F.count_if((c("dir") > 0) & c("confirmed")).alias("confirmed_up"),
            F.count_if((c("dir") < 0) & c("confirmed")).alias("confirmed_down"),
            F.count_if(c("move") > 0).alias("target_raises"),
            F.count_if(c("move") <= 0).alias("target_cuts"),
            F.count_if((c("move") > 0) & c("confirmed")).alias("target_raises_confirmed"),
            F.count_if((c("move") <= 0) & c("confirmed")).alias("target_cuts_confirmed"),
            F.round(F.median(F.when(c("move") > 0, c("move"))), 2).alias("median_raise_pct"),
            F.round(F.median(F.when(c("move") <= 0, c("move"))), 2).alias("median_cut_pct"),
            F.count_if("entered").alias("entered_n"),
            F.count_if("left").alias("left_n"),
        )
        .withColumn("window_days", F.date_diff("as_of", "prev_as_of"))
    )


def view_counts(panel: DataFrame) -> DataFrame:
    """Score movements among emitted rows, per window."""
    return (
        pair_rows(panel)
        .where(emitted())
        .groupBy("as_of")
        .agg(
            F.count(F.lit(1)).alias("emitted_rows"),
            F.count_if(F.col("ss_d") > 0).alias("score_up"),
            F.count_if(F.col("ss_d") < 0).alias("score_down"),
        )
    )


def _breadth(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.groupBy("as_of", sg.sector_name(c("sector")).alias("sector")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(c("dir") > 0) - F.count_if(c("dir") < 0)).alias("net_upgrades"),
        F.count_if(c("bt_pct") > 0).alias("raises"),
        F.count_if(c("bt_pct") < 0).alias("cuts"),
        F.count_if(emitted()).alias("emitted"),
    )


def breadth_public(panel: DataFrame) -> DataFrame:
    """Sector breadth over every paired name."""
    return _breadth(pair_rows(panel)).select("as_of", "sector", "net_upgrades", "raises", "cuts")


def breadth_view(panel: DataFrame) -> DataFrame:
    """Sector breadth over sectors with at least one emitted row, with the paired count."""
    return (
        _breadth(pair_rows(panel))
        .where(F.col("emitted") > 0)
        .select("as_of", "sector", "n", "net_upgrades", "raises", "cuts")
    )


def breadth_order(breadth: DataFrame) -> DataFrame:
    """Display order of sector breadth: most net upgrades first, ties by sector."""
    return breadth.orderBy("as_of", F.desc("net_upgrades"), "sector")


def churn_order(names: DataFrame) -> DataFrame:
    """Entered or left names by capture and key; sorted by range, so no capture is gathered in one task."""
    return names.orderBy("as_of", "ticker")


def entered(panel: DataFrame) -> DataFrame:
    """Liquid names not liquid at the capture before (the first capture has no window)."""
    return (
        adjacent(panel)
        .where(F.col("prev_as_of").isNotNull() & F.col("liquid") & ~_paired())
        .select("as_of", "ticker")
    )


def left_names(panel: DataFrame) -> DataFrame:
    """Names liquid at the capture before and not now, with the reason."""
    gone = ~F.coalesce(F.col("n.liquid"), F.lit(False))
    reason = (
        F.when(F.col("n").isNull(), "absent from this week's export")
        .when(~F.col("n.matched"), "unmatched on the feed")
        .otherwise("lost index membership or liquidity floor")
    )
    return (
        adjacent(panel)
        .where(F.col("next_as_of").isNotNull() & F.col("liquid") & gone)
        .select(F.col("next_as_of").alias("as_of"), "ticker", reason.alias("reason"))
    )


def weekly_series(panel: DataFrame) -> DataFrame:
    """Cross-section aggregates of each capture with the move counts of its window."""
    moves = pair_counts(panel).select("as_of", "upgrades", "downgrades", "target_raises", "target_cuts")
    return attach_per_capture(crosssection.week_aggregates(panel), moves)
