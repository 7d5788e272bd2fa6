"""Event-log diagnostics: confirmation sweep over capture pairs and target flow per window.

A log row carries ticker, capture_ord, cap_ts (Singapore), et (US Eastern), the label, the best
target and the rating date. It is unique per (ticker, capture).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import clock
from panelflow.functions import signals as sg
from panelflow.schema import FLOW_FLOOR_PCT
from panelflow.session import stored

MEASURES = ["paired", "up", "down", "confirmed_up", "confirmed_down"]


def _runs(stretches: DataFrame, same: list[str]) -> DataFrame:
    """Join consecutive stretches [s, e] of a ticker over which its `same` columns do not change."""
    w = Window.partitionBy("ticker").orderBy("s")
    touches = F.coalesce(F.col("_h.e") == F.col("s") - 1, F.lit(False))
    for c in same:
        touches = touches & F.col(f"_h.{c}").eqNullSafe(F.col(c))
    return (
        stretches.withColumn("_h", F.lag(F.struct("e", *same)).over(w))
        .withColumn("_run", F.sum(F.when(touches, 0).otherwise(1)).over(w))
        .groupBy("ticker", "_run", *same)
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("_run")
    )


def _block(a1: Column, a2: Column, b1: Column, b2: Column, weights: dict[str, Column]) -> Column:
    """The four corner increments whose double running sum is a block of pairs."""
    def corner(a: Column, b: Column, sign: int) -> Column:
        marks = [(weights.get(m, F.lit(0)) * sign).cast("long").alias(m) for m in MEASURES]
        return F.struct(a.cast("int").alias("a_ord"), b.cast("int").alias("b_ord"), *marks)

    return F.array(corner(a1, b1, 1), corner(a2 + 1, b1, -1), corner(a1, b2 + 1, -1), corner(a2 + 1, b2 + 1, 1))


def confirmation_sweep(log: DataFrame, captures: DataFrame) -> DataFrame:
    """Label changes and confirmed changes between every ordered pair of captures.

    Names are never paired capture by capture. A name's label is cut into runs; two runs that
    differ add one block of (a, b) pairs, written as four corner increments, and the blocks of
    all names are summed before a double running sum over the captures-by-captures grid restores
    the counts. Work follows the label changes, not names times pairs.
    """
    c = F.col
    labelled = log.select(
        "ticker", sg.label_rank(c("analyst_consensus")).alias("rank"), "rating_date",
        c("capture_ord").alias("s"), c("capture_ord").alias("e"),
    ).where("rank IS NOT NULL")
    # the log compressed to its changes, written once: every later step reads only this
    target = stored(_runs(labelled, ["rank", "rating_date"]), "runs")
    held = _runs(target, ["rank"])
    present = _runs(target, []).select("ticker", "s", "e")
    caps = captures.select("capture_ord", F.to_date("et").alias("day"))
    spans = _date_limits(target.select("rating_date").where("rating_date IS NOT NULL").distinct(), caps)
    later = present.select("ticker", c("s").alias("s2"), c("e").alias("e2"))
    pairs = present.join(later, "ticker").where("s2 >= s")
    one = F.lit(1)
    paired = pairs.select(F.inline(_block(c("s"), c("e"), c("s2"), c("e2"), {"paired": one})))

    dated = target.join(spans, "rating_date", "left").select(
        "ticker", c("rank").alias("rank2"), c("s").alias("s2"), c("e").alias("e2"), "last_on_before", "first_on_after"
    )
    moves = held.join(dated, "ticker").where((c("e") < c("s2")) & (c("rank") != c("rank2")))
    up, down = (c("rank2") < c("rank")).cast("int"), (c("rank2") > c("rank")).cast("int")
    a2 = F.least(c("e"), c("last_on_before"))
    b1 = F.greatest(c("s2"), c("first_on_after"))
    dated_block = c("last_on_before").isNotNull() & c("first_on_after").isNotNull() & (a2 >= c("s")) & (b1 <= c("e2"))
    changes = moves.select(F.inline(_block(c("s"), c("e"), c("s2"), c("e2"), {"up": up, "down": down})))
    confirmed = moves.where(dated_block).select(
        F.inline(_block(c("s"), a2, b1, c("e2"), {"confirmed_up": up, "confirmed_down": down}))
    )
    corners = (
        paired.unionByName(changes)
        .unionByName(confirmed)
        .groupBy("a_ord", "b_ord")
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
    )
    grid = capture_pairs(captures, whole=True)
    along_a = Window.partitionBy("b_ord").orderBy("a_ord").rowsBetween(Window.unboundedPreceding, 0)
    along_b = Window.partitionBy("a_ord").orderBy("b_ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(corners, ["a_ord", "b_ord"], "left").fillna(0, MEASURES)
    for w in (along_a, along_b):
        filled = filled.withColumns({m: F.sum(m).over(w) for m in MEASURES})
    counts = filled.where("a_ord < b_ord")
    ends = lambda side: captures.select(F.col("capture_ord").alias(f"{side}_ord"), F.col("et").alias(f"{side}_et"))
    conf = c("confirmed_up") + c("confirmed_down")
    return (
        counts.join(ends("a"), "a_ord")
        .join(ends("b"), "b_ord")
        .withColumn("changes", c("up") + c("down"))
        .select(
            "a_ord", "b_ord", "paired", "changes", "up", "down",
            conf.alias("confirmed"),
            F.round(clock.elapsed_hours(c("a_et"), c("b_et")), 4).alias("hours"),
            (F.date_diff(F.to_date("b_et"), F.to_date("a_et")) + 1).alias("span"),
            F.round(F.try_divide(conf, c("changes")), 4).alias("rate"),
        )
    )


def _date_limits(dated: DataFrame, caps: DataFrame) -> DataFrame:
    """For each rating date: last capture dated on or before it, first dated on or after it."""
    days = caps.groupBy("day").agg(F.min("capture_ord").alias("lo"), F.max("capture_ord").alias("hi"))
    marks = days.select(F.col("day").alias("d"), "lo", "hi", F.lit(False).alias("probe")).unionByName(
        dated.select(F.col("rating_date").alias("d"), F.lit(None).cast("int").alias("lo"),
                     F.lit(None).cast("int").alias("hi"), F.lit(True).alias("probe"))
    )
    # one row per calendar day at most, so ordering all of them in one window is bounded
    back = Window.orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.orderBy("d").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        marks.withColumn("last_on_before", F.max("hi").over(back))
        .withColumn("first_on_after", F.min("lo").over(ahead))
        .where("probe")
        .select(F.col("d").alias("rating_date"), "last_on_before", "first_on_after")
    )


def capture_pairs(captures: DataFrame, whole: bool = False) -> DataFrame:
    """Ordinal pairs of the capture dimension: the shape of the sweep's own result."""
    limits = captures.agg(F.min("capture_ord").alias("lo"), F.max("capture_ord").alias("hi"))
    first = F.explode(F.sequence("lo", "hi"))
    rows = limits.select("lo", "hi", first.alias("a_ord"))
    start = F.col("lo") if whole else F.col("a_ord") + 1
    if not whole:
        rows = rows.where("a_ord < hi")
    return rows.select("a_ord", F.explode(F.sequence(start, F.col("hi"))).alias("b_ord"))


def useful_pairs(sweep: DataFrame, min_changes: int = 3) -> DataFrame:
    return sweep.where(F.col("changes") >= min_changes)


def _shares(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("changes").alias("changes"),
        F.sum("confirmed").alias("confirmed"),
        F.round(F.try_divide(F.sum("confirmed"), F.sum("changes")), 4).alias("rate"),
    )


def by_elapsed(sweep: DataFrame, min_changes: int = 3) -> DataFrame:
    """Confirmed share per elapsed-time bucket on the fixed bucket domain, zero filled."""
    h = F.col("hours")
    # fixed values: bucket edges in hours
    edges = [("< 1 day", h < 24), ("1-2 days", (h >= 24) & (h < 48)), ("2-4 days", (h >= 48) & (h < 96)), ("4+ days", h >= 96)]
    cells = []
    for name, inside in edges:
        n = lambda c, i=inside: F.coalesce(F.sum(F.when(i, F.col(c))), F.lit(0))
        cells.append(
            F.struct(
                F.lit(name).alias("bucket"), F.count_if(inside).alias("pairs"), n("changes").alias("changes"),
                n("confirmed").alias("confirmed"),
                F.round(F.try_divide(n("confirmed"), n("changes")), 4).alias("rate"),
            )
        )
    return useful_pairs(sweep, min_changes).agg(F.array(*cells).alias("_m")).select(F.inline("_m"))


def by_span(sweep: DataFrame, min_changes: int = 3) -> DataFrame:
    return _shares(useful_pairs(sweep, min_changes), "span")


def within_span(sweep: DataFrame, min_changes: int = 3, min_range_hours: float = 6.0) -> DataFrame:
    """Shorter and longer halves of each span with enough elapsed-time variation."""
    w = Window.partitionBy("span")
    n, place = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("hours", "a_ord", "b_ord"))
    wide = F.max("hours").over(w) - F.min("hours").over(w) >= min_range_hours
    split = (
        useful_pairs(sweep, min_changes)
        .select("*", n.alias("_n"), place.alias("_k"), wide.alias("_wide"))
        .where("_n >= 2 AND _wide")
        .withColumn("half", F.when(F.col("_k") <= F.floor(F.col("_n") / 2), "shorter").otherwise("longer"))
    )
    return split.groupBy("span", "half").agg(
        F.min("hours").alias("from_hours"),
        F.max("hours").alias("to_hours"),
        F.sum("changes").alias("changes"),
        F.sum("confirmed").alias("confirmed"),
        F.round(F.try_divide(F.sum("confirmed"), F.sum("changes")), 4).alias("rate"),
    )


# ---- target flow ---------------------------------------------------------------------------


def target_percent(before: Column, now: Column) -> Column:
    """Move of a target in per cent; null where a target is absent or the one before is 0."""
    return (now - before) / F.nullif(before, F.lit(0.0)) * 100.0


def past_floor(pct: Column, floor_pct: float = FLOW_FLOOR_PCT, strict_reference: bool = False) -> Column:
    keep = F.abs(pct) >= floor_pct
    return keep if strict_reference else keep & (pct != 0)


def flow_rows(log: DataFrame, floor_pct: float = FLOW_FLOOR_PCT, strict_reference: bool = False) -> DataFrame:
    """Adjacent-capture target moves of each name; window `w` runs from capture w-1 to capture w.

    With a floor of 0 an unmoved name would count as a cut; that happens only under
    `strict_reference`.
    """
    w = Window.partitionBy("ticker").orderBy("capture_ord")
    prev = F.lag(F.struct("capture_ord", "et", F.col("best_analyst_price_target").alias("t"))).over(w)
    a, b = F.col("_p.t"), F.col("best_analyst_price_target")
    pct = target_percent(a, b)
    keep = past_floor(pct, floor_pct, strict_reference)
    return (
        log.withColumn("_p", prev)
        .where(F.col("_p.capture_ord") == F.col("capture_ord") - 1)
        .where(b.isNotNull() & F.nullif(a, F.lit(0.0)).isNotNull())
        .select(
            F.col("capture_ord").alias("w"), "ticker",
            F.when(keep, F.round(pct, 4)).alias("move"),
            F.when(keep, sg.within(F.col("rating_date"), F.to_date("_p.et"), F.to_date("et"))).alias("dated"),
        )
    )


def flow_windows(log: DataFrame, captures: DataFrame, floor_pct: float = FLOW_FLOOR_PCT, strict_reference: bool = False) -> DataFrame:
    """Moves, raises, cuts and dated share per window with its session class."""
    m = F.col("move")
    counts = flow_rows(log, floor_pct, strict_reference).groupBy("w").agg(
        F.count(F.lit(1)).alias("paired"),
        F.count("move").alias("moves"),
        F.count_if(m > 0).alias("raises"),
        F.count_if(m <= 0).alias("cuts"),
        F.count_if("dated").alias("_dated"),
    )
    order = Window.orderBy("capture_ord")
    spans = captures.select(F.col("capture_ord").alias("w"), F.lag("et").over(order).alias("a_et"), F.col("et").alias("b_et"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        spans.where("a_et IS NOT NULL")
        .join(counts, "w", "left")
        .select(
            "w",
            clock.window_kind(F.col("a_et"), F.col("b_et")).alias("kind"),
            F.round(clock.elapsed_hours(F.col("a_et"), F.col("b_et")), 4).alias("hours"),
            zero("paired"), zero("moves"), zero("raises"), zero("cuts"),
            F.round(F.try_divide(F.col("_dated"), F.col("moves")), 4).alias("dated_share"),
        )
    )


def flow_overlap(log: DataFrame, floor_pct: float = FLOW_FLOOR_PCT) -> DataFrame:
    """Names and magnitudes two consecutive windows share; all identical marks a duplicate."""
    movers = flow_rows(log, floor_pct).where("move IS NOT NULL")
    w = Window.partitionBy("ticker").orderBy("w")
    before = F.lag(F.struct("w", "move")).over(w)
    shared = F.coalesce(F.col("_b.w") == F.col("w") - 1, F.lit(False))
    pair = movers.withColumn("_b", before).groupBy("w").agg(
        F.count(F.lit(1)).alias("moves_b"),
        F.count_if(shared).alias("shared"),
        F.count_if(shared & (F.col("_b.move") == F.col("move"))).alias("identical"),
    )
    order = Window.orderBy("w")
    back = F.lag(F.struct("w", "moves_b")).over(order)
    return (
        pair.withColumn("_p", back)
        .where(F.col("_p.w") == F.col("w") - 1)
        .select(
            (F.col("w") - 1).alias("window_a"), F.col("w").alias("window_b"),
            F.col("_p.moves_b").alias("moves_a"), "moves_b", "shared", "identical",
            ((F.col("identical") > 0) & (F.col("identical") == F.col("shared"))).alias("duplicate"),
        )
    )


def night_and_day(windows: DataFrame) -> DataFrame:
    """Move counts of windows with and without an overnight stretch, in window order."""
    group = F.when(F.col("kind").isin("overnight", "pre-open"), "night").otherwise("day")
    ordered = F.array_sort(F.collect_list(F.struct("w", "moves")))
    return windows.groupBy(group.alias("class")).agg(
        F.count(F.lit(1)).alias("windows"),
        F.array_join(F.transform(ordered, lambda s: s["moves"].cast("string")), ",").alias("moves"),
    )
