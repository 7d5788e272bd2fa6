"""Exact-reversion test: does a level return where no rating action explains it?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import signals as sg
from panelflow.schema import FLOW_FLOOR_PCT


def classify(log: DataFrame, captures: DataFrame, floor_pct: float = FLOW_FLOOR_PCT, strict_reference: bool = False) -> DataFrame:
    """Per name present with a non-zero target in every capture: moves, reverted, rating static."""
    w = Window.partitionBy("ticker").orderBy("capture_ord")
    level = F.round("best_analyst_price_target", 4)
    change = F.abs(F.col("v") / F.nullif(F.col("before"), F.lit(0.0)) - 1.0) * 100.0
    moved = change >= floor_pct
    if not strict_reference:
        moved = moved & (change != 0)
    first_seen = F.min("capture_ord").over(Window.partitionBy("ticker", "v"))
    total = captures.agg(F.count(F.lit(1))).scalar()
    complete = log.withColumn("v", level).withColumn("before", F.lag("v").over(w))
    return (
        complete.withColumn("back", (F.col("v") != F.col("before")) & (first_seen < F.col("capture_ord")))
        .groupBy("ticker")
        .agg(
            F.count(F.when(F.coalesce(F.col("best_analyst_price_target") != 0, F.lit(False)), 1)).alias("_n"),
            F.count_if(moved).alias("moves"),
            F.coalesce(F.bool_or("back"), F.lit(False)).alias("reverted"),
            F.coalesce(F.min("rating_date") == F.max("rating_date"), F.lit(True)).alias("rating_static"),
        )
        .where(F.col("_n") == total)
        .drop("_n")
    )


def contingency(classes: DataFrame) -> DataFrame:
    """Movers by (rating static, reverted): names and moves; always four rows."""
    cells = []
    for static in (True, False):
        for back in (True, False):
            hit = (F.col("rating_static") == static) & (F.col("reverted") == back)
            cells.append(
                F.struct(
                    F.lit(static).alias("rating_static"), F.lit(back).alias("reverted"),
                    F.count_if(hit).alias("names"),
                    F.coalesce(F.sum(F.when(hit, F.col("moves"))), F.lit(0)).alias("moves"),
                )
            )
    return classes.where("moves > 0").agg(F.array(*cells).alias("_m")).select(F.inline("_m"))


def z_test(classes: DataFrame) -> DataFrame:
    """Two-proportion z of the reverted share, static against changed rating dates."""
    c = F.col
    arm = lambda static: (c("rating_static") == static)
    one = classes.where("moves > 0").agg(
        F.count_if(arm(True)).alias("n1"),
        F.count_if(arm(True) & c("reverted")).alias("x1"),
        F.count_if(arm(False)).alias("n2"),
        F.count_if(arm(False) & c("reverted")).alias("x2"),
    )
    pool = F.try_divide(c("x1") + c("x2"), c("n1") + c("n2"))
    se = F.sqrt(pool * (1.0 - pool) * (F.try_divide(F.lit(1.0), c("n1")) + F.try_divide(F.lit(1.0), c("n2"))))
    return (
        one.withColumn("p_static", F.try_divide(c("x1"), c("n1")))
        .withColumn("p_changed", F.try_divide(c("x2"), c("n2")))
        .withColumn("_z", F.when(se > 0, (c("p_static") - c("p_changed")) / F.nullif(se, F.lit(0.0))).when(se == 0, 0.0))
        .withColumn("_p", sg.two_sided_normal_p(c("_z")))
        .select(
            "n1", "x1", "n2", "x2",
            F.round("p_static", 6).alias("p_static"),
            F.round("p_changed", 6).alias("p_changed"),
            F.round(F.try_divide(c("p_static"), c("p_changed")), 6).alias("ratio"),
            F.round("_z", 6).alias("z"),
            F.round("_p", 6).alias("p_value"),
            F.coalesce((c("_p") < 0.05) & (c("p_static") > c("p_changed")), F.lit(False)).alias("discriminates"),
            (F.least("n1", "n2") < 50).alias("caution"),
        )
    )


def examples(classes: DataFrame, n: int) -> DataFrame:
    """Most-moving reverting names with a static rating date (a top-n report)."""
    return classes.where("moves > 0 AND reverted AND rating_static").orderBy(F.desc("moves"), "ticker").limit(n)


def present_throughout(log: DataFrame, captures: DataFrame) -> DataFrame:
    """Names found in every capture of a stream."""
    total = captures.agg(F.count(F.lit(1))).scalar()
    return log.groupBy("ticker").agg(F.count(F.lit(1)).alias("captures")).where(F.col("captures") == total)
