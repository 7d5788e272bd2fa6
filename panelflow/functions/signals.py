"""Row-level signal expressions shared by the view, public and event-log operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow.schema import BUY_LABELS, CONSENSUS_ORDER, MOVE_FLOOR, SECTOR_BLANK


def label_rank(c: Column) -> Column:
    """0 for the best label to 4 for the worst; null outside the domain."""
    at = F.array_position(F.array(*[F.lit(x) for x in CONSENSUS_ORDER]), c)
    return (F.nullif(at, F.lit(0)) - 1).cast("int")


def label_direction(prev: Column, now: Column) -> Column:
    """+1 improved, -1 worsened, 0 unchanged or outside the domain."""
    return F.coalesce(F.signum(label_rank(prev) - label_rank(now)).cast("int"), F.lit(0))


def truthy(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def target_move(prev: Column, now: Column, floor: float = MOVE_FLOOR) -> Column:
    """Percent move of a level, two decimals; null below the floor or where a level is absent."""
    change = truthy(now) / truthy(prev) - 1.0
    return F.when(F.abs(change) >= floor, F.round(change * 100.0, 2))


def is_buy(label: Column) -> Column:
    return F.coalesce(label.isin(BUY_LABELS), F.lit(False))


def sector_name(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(SECTOR_BLANK))


def within(d: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(d.between(lo, hi), F.lit(False))


def changed(prev: Column, now: Column) -> Column:
    """Categorical flip: a blank counts as null, null to value counts as a flip."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return ~blank(prev).eqNullSafe(blank(now))


def target_gap(best: Column, consensus: Column) -> Column:
    ok = consensus > 0
    return F.when(ok, F.round((best / F.nullif(consensus, F.lit(0.0)) - 1.0) * 100.0, 1))


def upside_per_vol(upside: Column, vol: Column) -> Column:
    return F.when(vol > 0, F.round(upside / F.nullif(vol, F.lit(0.0)), 2))


def action_score(direction: Column, confirmed: Column, move: Column, score_delta: Column) -> Column:
    """Label move 5 or 3, target move 2/3/4 by size, score tick 1, each signed, summed."""
    label = direction * F.when(confirmed, 5).otherwise(3)
    size = F.abs(move)
    points = F.when(size < 1.0, 2).when(size < 5.0, 3).otherwise(4)
    target = F.coalesce(F.when(move > 0, points).otherwise(F.when(move.isNotNull(), -points)), F.lit(0))
    tick = F.coalesce(F.when(score_delta > 0, 1).when(score_delta < 0, -1), F.lit(0))
    return (label + target + tick).cast("int")


def badge(score: Column) -> Column:
    return F.when(score > 0, "up").when(score < 0, "down")


def plain_number(c: Column) -> Column:
    """Shortest text of a number, without a trailing `.0`."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def stance(c: Column) -> Column:
    """Sentiment bucket of a free-text category."""
    return (
        F.when(c.rlike("(?i)positive|bullish"), "positive")
        .when(c.rlike("(?i)negative|bearish"), "negative")
        .otherwise("neutral")
    )


def two_sided_normal_p(z: Column) -> Column:
    """Two-sided normal tail from the rational erf approximation 7.1.26 (error below 1.5e-7)."""
    # fixed values: the published coefficients of the approximation, highest power first
    coefficients = [1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592]
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    for k in coefficients:
        poly = (poly + F.lit(k)) * t
    return poly * F.exp(-x * x)
