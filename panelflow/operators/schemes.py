"""Graded signal schemes: event buckets, score classes, residualised composite, gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import signals as sg
from panelflow.operators.ordered import medians, quantiles, ranked_values
from panelflow.operators.revision import adjacent
from panelflow.session import attach, attach_per_capture, stored

SCORE_CLASS_FLOOR = 90


def scheme_rows(panel: DataFrame) -> DataFrame:
    """Liquid rows with the signed label move, confirmation and target revision.

    A name without a liquid record at the capture before carries no move.
    """
    paired = F.coalesce(F.col("p.liquid"), F.lit(False))
    prev, now = F.col("p.best_analyst_price_target"), F.col("best_analyst_price_target")
    direction = sg.label_direction(F.col("p.analyst_consensus"), F.col("analyst_consensus"))
    return (
        adjacent(panel)
        .where("liquid")
        .withColumn("dir", F.when(paired, direction).otherwise(0))
        .withColumn("confirmed", paired & sg.within(F.col("rating_date"), F.col("prev_as_of"), F.col("as_of")))
        .withColumn(
            "target_pct",
            F.when(paired, F.round((sg.truthy(now) / sg.truthy(prev) - 1.0) * 100.0, 6)),
        )
        .drop("p", "n")
    )


def rating_change(rows: DataFrame) -> DataFrame:
    """Confirmed label improvement."""
    return rows.where((F.col("dir") > 0) & F.col("confirmed"))


def target_raise(rows: DataFrame, floor_pct: float | None = None, date_guard: bool = False) -> DataFrame:
    """Best-target level raised; optional floor and rating-date guard (both off by default)."""
    keep = F.col("target_pct") > 0
    if floor_pct is not None:
        keep = keep & (F.col("target_pct") >= floor_pct)
    if date_guard:
        keep = keep & F.col("confirmed")
    return rows.where(keep)


def with_rank(rows: DataFrame, value: str, out: str = "place") -> DataFrame:
    """Competition rank of a value inside its capture, largest first, without a capture-wide sort."""
    ranks = ranked_values(rows, ["as_of"], value).select(
        "as_of", value, (F.col("n_total") - F.col("n_below") - F.col("n_equal") + 1).alias(out)
    )
    return rows.join(ranks, ["as_of", value], "left")


def score_classes(rows: DataFrame, at_least: int = SCORE_CLASS_FLOOR) -> DataFrame:
    """Smallest top set of whole score classes reaching `at_least` names, per capture."""
    w = Window.partitionBy("as_of").orderBy(F.desc("smart_score")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per score class: bounded by the score scale, not by the names
    classes = rows.where("smart_score IS NOT NULL").groupBy("as_of", "smart_score").agg(F.count(F.lit(1)).alias("class_n"))
    return classes.withColumn("n_above", F.coalesce(F.sum("class_n").over(w), F.lit(0))).where(F.col("n_above") < at_least)


def score_bucket(rows: DataFrame, at_least: int = SCORE_CLASS_FLOOR) -> DataFrame:
    kept = score_classes(rows, at_least).select("as_of", "smart_score", F.lit(True).alias("_in"))
    return attach(rows, kept, ["as_of", "smart_score"], "inner").drop("_in")


def gated(rows: DataFrame) -> DataFrame:
    """Confirmed improvement, return above the liquid median, insider not net selling."""
    mid = medians(rows, ["as_of"], {"_mid": F.col("tr_3m_pct")})
    bought = ~F.col("insider_signal").eqNullSafe(F.lit("Negative"))
    return attach_per_capture(rating_change(rows), mid).where((F.col("tr_3m_pct") > F.col("_mid")) & bought).drop("_mid")


def composite_components() -> dict[str, Column]:
    insider = F.when(F.col("insider_signal") == "Positive", 1.0).when(F.col("insider_signal") == "Negative", -1.0)
    return {
        "rating": F.when(F.col("confirmed"), F.col("dir").cast("double")).otherwise(0.0),
        "target": F.coalesce(F.col("target_pct"), F.lit(0.0)),
        "insider": F.coalesce(insider, F.lit(0.0)),
    }


def winsor_zscores(rows: DataFrame, columns: dict[str, Column], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows with `<name>_z`: values clipped at the capture's quantiles, then standardised."""
    base = rows.withColumns({f"_{n}": c for n, c in columns.items()})
    q = quantiles(base, ["as_of"], {n: F.col(f"_{n}") for n in columns}, [low, high])
    bounds = q.groupBy("as_of").agg(
        *[
            F.max(F.when(F.col("_name") == n, F.col(side))).alias(f"_{n}_{side}")
            for n in columns
            for side in ("q0", "q1")
        ]
    )
    clipped = attach_per_capture(base, bounds).withColumns(
        {f"_{n}": F.greatest(F.least(F.col(f"_{n}"), F.col(f"_{n}_q1")), F.col(f"_{n}_q0")) for n in columns}
    )
    moments = clipped.groupBy("as_of").agg(
        *[F.avg(f"_{n}").alias(f"_{n}_m") for n in columns], *[F.stddev_samp(f"_{n}").alias(f"_{n}_s") for n in columns]
    )
    z = lambda n: F.coalesce(F.try_divide(F.col(f"_{n}") - F.col(f"_{n}_m"), F.col(f"_{n}_s")), F.lit(0.0))
    return attach_per_capture(clipped, moments).select(*rows.columns, *[z(n).alias(f"{n}_z") for n in columns])


def style_controls() -> dict[str, Column]:
    """Log size, yield (blank reads as zero) and beta."""
    return {
        "size": F.ln("market_cap"),
        "yield": F.coalesce(F.col("dividend_yield"), F.lit(0.0)),
        "beta": F.col("beta"),
    }


# A control counts as dead in a capture where less than this share of its squares, or of its spread, is its own.
DEAD_SQUARES, DEAD_SPREAD = 1e-14, 1e-10


def style_residual(
    rows: DataFrame, value: str, out: str = "residual", controls: dict[str, Column] | None = None, rank: str | None = None
) -> DataFrame:
    """Residual of `value` on three controls and sector dummies, per capture.

    Sector dummies are absorbed by sector means; the three slopes come from centred products per (capture,
    sector), so rows are only aggregated and joined, never gathered by capture. Controls are eliminated one
    after another: one that is constant inside sectors, or follows from those before it, gets slope zero and
    leaves the others as they are. `rank` names a column for the number of controls that counted. The mean
    residual of every sector, hence of every capture, is zero.
    """
    named = list((controls or style_controls()).items())
    x = [f"_x{i}" for i in range(3)]
    sector = sg.sector_name(F.col("sector")).alias("_sector")
    base = rows.select("*", sector, *[c.alias(x[i]) for i, (_, c) in enumerate(named)])
    full = F.lit(True)
    for c in (*x, value):
        full = full & F.col(c).isNotNull()
    v = [*x, value]
    pairs = [(i, j) for i in range(4) for j in range(i, 4) if (i, j) != (3, 3)]
    sums = base.where(full).groupBy("as_of", "_sector").agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(v)],
        *[(F.covar_pop(v[i], v[j]) * F.count(F.lit(1))).alias(f"_p{i}{j}") for i, j in pairs],
        *[F.sum(F.col(c) * F.col(c)).alias(f"_q{k}") for k, c in enumerate(x)],
    )
    # a few rows per capture (one per sector)
    capture = Window.partitionBy("as_of")
    solved = sums.withColumns({
        **{f"_g{i}{j}": F.sum(f"_p{i}{j}").over(capture) for i, j in pairs},
        **{f"_d{k}": F.sum(f"_p{k}{k}").over(capture) for k in range(3)},
        **{f"_q{k}": F.sum(f"_q{k}").over(capture) for k in range(3)},
    })
    g = lambda i, j: F.col(f"_g{i}{j}")
    ratio = lambda k, top: F.when(F.col(f"_live{k}"), F.try_divide(top, g(k, k))).otherwise(F.lit(0.0))
    for k in range(3):
        live = (g(k, k) > F.col(f"_q{k}") * DEAD_SQUARES) & (g(k, k) > F.col(f"_d{k}") * DEAD_SPREAD)
        solved = solved.withColumn(f"_live{k}", live)
        solved = solved.withColumns({
            f"_g{i}{j}": g(i, j) - ratio(k, g(k, i)) * g(k, j) for i in range(k + 1, 3) for j in range(i, 4)
        })
    for k in (2, 1, 0):
        rest = g(k, 3)
        for j in range(k + 1, 3):
            rest = rest - g(k, j) * F.col(f"_b{j}")
        solved = solved.withColumn(f"_b{k}", ratio(k, rest))
    intercept = F.col("_m3")
    for k in range(3):
        intercept = intercept - F.col(f"_b{k}") * F.col(f"_m{k}")
    counted = F.col("_live0").cast("int") + F.col("_live1").cast("int") + F.col("_live2").cast("int")
    coefficients = solved.select(
        "as_of", "_sector", intercept.alias("_a"), "_b0", "_b1", "_b2", *([counted.alias(rank)] if rank else []))
    fit = F.col("_a")
    for k in range(3):
        fit = fit + F.col(f"_b{k}") * F.col(x[k])
    return (
        attach(base, coefficients, ["as_of", "_sector"])
        .withColumn(out, F.col(value) - fit)
        .drop("_sector", "_a", "_b0", "_b1", "_b2", *x)
    )


def composite(rows: DataFrame) -> DataFrame:
    """Equal-weight sum of winsorised z-scores, residualised on style.

    The scores are stored once: the regression sums and the residuals both read them.
    """
    z = winsor_zscores(rows, composite_components())
    summed = stored(z.withColumn("composite", F.col("rating_z") + F.col("target_z") + F.col("insider_z")), "composite")
    return style_residual(summed, "composite", "composite_residual").withColumn(
        "composite_residual", F.round("composite_residual", 9)
    )


def rank_share(rows: DataFrame, value: str, out: str = "rank_share") -> DataFrame:
    """Share of the capture's valued names strictly above a row (0 for the best)."""
    r = ranked_values(rows, ["as_of"], value)
    share = (F.col("n_total") - F.col("n_below") - F.col("n_equal")) / F.col("n_total")
    return rows.join(r.select("as_of", value, share.alias(out)), ["as_of", value], "left")


def top_share(rows: DataFrame, value: str, share: float = 0.10) -> DataFrame:
    return rank_share(rows, value).where(F.col("rank_share") < share)


def all_schemes(rows: DataFrame) -> DataFrame:
    """Members of the five schemes, one row per (scheme, capture, name)."""
    keep = list(rows.columns)
    parts = {
        "S1a": rating_change(rows),
        "S1b": target_raise(rows),
        "S1c": score_bucket(rows),
        "S2": top_share(composite(rows), "composite_residual"),
        "S3": gated(rows),
    }
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("scheme"), *keep)
        out = part if out is None else out.unionByName(part)
    return out


def after_registration(members: DataFrame, registered: DataFrame) -> DataFrame:
    """Clock start: a scheme is graded only on captures after its registration date."""
    return members.join(registered, "scheme").where("as_of > registered_on").drop("registered_on")


def event_counts(members: DataFrame, by: Sequence[str] = ("scheme", "as_of")) -> DataFrame:
    return members.groupBy(*by).agg(F.count(F.lit(1)).alias("names"))
