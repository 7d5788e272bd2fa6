"""Backward as-of joins: the state of a key at given instants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import BROADCAST_ROWS


def number_captures(captures: DataFrame, order: Sequence[str], first: int = 1) -> DataFrame:
    """Capture ordinal. Captures are few (at most one per stamp), so one ordered window is safe."""
    return captures.withColumn(
        "capture_ord", F.row_number().over(Window.orderBy(*order)) + F.lit(first - 1)
    )


def _by_day(captures: DataFrame, at: str) -> DataFrame:
    """One row per (calendar day, capture) for the interval each capture closes."""
    return (
        captures.withColumn("_lo", F.lag(at).over(Window.orderBy(at)))
        .withColumn("_hi", F.col(at))
        .withColumn("_from", F.to_date(F.coalesce("_lo", "_hi")))
        .withColumn("_first", F.col("_lo").isNull())
        .withColumn("_day", F.explode(F.sequence(F.col("_from"), F.to_date("_hi"))))
    )


def assign_capture(
    events: DataFrame, ts: str, captures: DataFrame, at: str, strict: bool = False
) -> DataFrame:
    """Give every event the first capture at or after it (strictly after it with `strict`).

    Intervals between captures are spread over calendar days and matched by day, then by the
    interval bounds: an equi-join, never a comparison of every event with every capture.
    Events before the first interval belong to the first capture, later ones to none.
    """
    days = _by_day(captures, at)
    if dict(captures.dtypes)[at] == "date":
        small = True  # disjoint DATE intervals: at most one row per calendar day and capture
    else:
        small = captures.count() <= BROADCAST_ROWS
    days = F.broadcast(days) if small else days
    opening = captures.agg(F.to_date(F.min(at))).scalar()
    e = events.withColumn("_when", F.col(ts).cast(dict(captures.dtypes)[at])).withColumn(
        "_key_day", F.greatest(F.to_date("_when"), opening)
    )
    over, under = (
        (F.col("_when") >= F.col("_lo"), F.col("_when") < F.col("_hi"))
        if strict
        else (F.col("_when") > F.col("_lo"), F.col("_when") <= F.col("_hi"))
    )
    match = (F.col("_key_day") == F.col("_day")) & (F.col("_first") | over) & under
    return e.join(days, match).drop(
        "_lo", "_hi", "_from", "_first", "_day", "_when", "_key_day"
    )


def state_at_captures(
    events: DataFrame,
    key: str,
    ts: str,
    tie: Sequence[str],
    payload: Sequence[str],
    captures: DataFrame,
    at: str = "as_of",
    strict: bool = False,
) -> DataFrame:
    """Last known payload of every key at every capture.

    Events collapse to the last one per (key, capture interval) with map-side combine, so a key
    with a third of all rows still leaves each task as a handful of rows. What remains per key is
    bounded by the number of captures and is carried forward to the next change.
    """
    order = [c for c in [ts, *tie]]
    cap_cols = ["capture_ord"]
    cap = captures.select(at, *cap_cols)
    tagged = assign_capture(events.select(key, *dict.fromkeys([*order, *payload])), ts, cap, at, strict)
    last = tagged.groupBy(key, "capture_ord").agg(
        F.max_by(F.struct(*payload), F.struct(*order)).alias("_state")
    )
    per_key = Window.partitionBy(key).orderBy("capture_ord")
    closing = captures.agg(F.max("capture_ord")).scalar()
    spans = (
        last.withColumn("_next", F.lead("capture_ord").over(per_key))
        .withColumn("_until", F.coalesce(F.col("_next") - 1, closing))
        .withColumn("capture_ord", F.explode(F.sequence("capture_ord", "_until")))
    )
    state = spans.select(key, "capture_ord", *[F.col(f"_state.{p}").alias(p) for p in payload])
    return with_capture_columns(state, captures)


def with_capture_columns(df: DataFrame, captures: DataFrame) -> DataFrame:
    """Attach the capture dimension by ordinal (one row per capture)."""
    small = "as_of" in captures.columns and "hhmm" not in captures.columns and dict(captures.dtypes)["as_of"] == "date"
    small = small or captures.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(captures) if small else captures, "capture_ord")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    strict: bool = False,
    bucket: Column | None = None,
    left_bucket: Column | None = None,
) -> DataFrame:
    """Left rows with the last right row at or before them (strictly before with `strict`).

    One union, one shuffle, no row blow-up. Without `bucket` a key's history is ordered in one
    task, which suits right sides whose rows per key are bounded by a calendar. For unbounded
    histories pass the time bucket of each side: rows are then ordered per (key, bucket) and the
    last state of earlier buckets is carried in from the bucket summaries.
    """
    on = list(on)
    extra = [c for c in left.columns if c not in on]
    lt = left.select(
        *on,
        F.col(left_ts).alias("_ts"),
        F.lit(0 if strict else 1).alias("_tag"),
        F.struct(*extra).alias("_left"),
        F.lit(None).alias("_right"),
        (left_bucket if left_bucket is not None else F.lit(0)).alias("_b"),
    )
    rt = right.select(
        *on,
        F.col(right_ts).alias("_ts"),
        F.lit(1 if strict else 0).alias("_tag"),
        F.lit(None).alias("_left"),
        F.struct(*[F.col(p) for p in payload]).alias("_right"),
        (bucket if bucket is not None else F.lit(0)).alias("_b"),
    )
    both = lt.unionByName(rt)
    if bucket is None:
        w = Window.partitionBy(*on).orderBy("_ts", "_tag").rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    else:
        w = Window.partitionBy(*on, "_b").orderBy("_ts", "_tag").rowsBetween(Window.unboundedPreceding, 0)
        closing = both.groupBy(*on, "_b").agg(
            F.max_by(F.col("_right"), F.when(F.col("_right").isNotNull(), F.col("_ts"))).alias("_close")
        )
        earlier = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = closing.select(*on, "_b", F.last("_close", ignorenulls=True).over(earlier).alias("_carry"))
        seen = (
            both.withColumn("_here", F.last("_right", ignorenulls=True).over(w))
            .where(F.col("_left").isNotNull())
            .join(carried, [*on, "_b"], "left")
            .withColumn("_hit", F.coalesce("_here", "_carry"))
        )
    hits = seen.where(F.col("_left").isNotNull())
    return hits.select(
        *on,
        *[F.col(f"_left.{c}").alias(c) for c in extra],
        *[F.col(f"_hit.{p}").alias(p) for p in payload],
    )
