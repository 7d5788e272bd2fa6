"""Resampling, multiple testing and verdict columns.

Draws come from md5 of their coordinates, so results do not depend on partitioning or order.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import signals as sg
from panelflow.operators.ordered import ranked_values, scattered_index
from panelflow.session import stored

EULER = 0.5772156649015329
N_SCHEMES = 5
SHARES = 4  # parts into which the replicates of a capture and bin are dealt out


def draw(n: Column, *coordinates: Column) -> Column:
    """Index in [0, n) decided by the coordinates alone."""
    digest = F.md5(F.concat_ws("-", *[c.cast("string") for c in coordinates]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % n


def spread(df: DataFrame) -> int:
    """Partitions for work that fans out from a small table."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def estimates(members: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Mean, count and hit rate per scheme and horizon."""
    cells = F.array(*[F.struct(F.lit(n).alias("horizon"), c.alias("v")) for n, c in values.items()])
    long = members.select("scheme", F.inline(cells)).where("v IS NOT NULL")
    return long.groupBy("scheme", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.avg((F.col("v") > 0).cast("double")).alias("hit_rate")
    )


def block_sums(members: DataFrame, value: str, life: int = 4) -> DataFrame:
    """Totals per scheme and time block; rows are reduced before anything is resampled."""
    block = F.floor((F.col("capture_ord") - 1) / life).cast("int")
    sums = (
        members.where(F.col(value).isNotNull())
        .groupBy("scheme", block.alias("block"))
        .agg(F.sum(F.col(value)).alias("total"), F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("scheme")  # one row per time block
    return sums.withColumn("idx", F.row_number().over(w.orderBy("block")) - 1).withColumn("n_blocks", F.count(F.lit(1)).over(w))


def block_bootstrap_ci(blocks: DataFrame, reps: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean under resampling of whole time blocks."""
    schemes = blocks.groupBy("scheme").agg(F.max("n_blocks").alias("n_blocks"))
    c = F.col
    draws = (
        schemes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        .withColumn("k", F.explode(F.sequence(F.lit(0), (c("n_blocks") - 1).cast("int"))))
        .withColumn("idx", draw(c("n_blocks"), F.lit(seed), c("scheme"), c("rep"), c("k")))
        .groupBy("scheme", "rep", "idx")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    means = draws.join(blocks.select("scheme", "idx", "total", "n"), ["scheme", "idx"]).groupBy("scheme", "rep").agg(
        (F.sum(c("total") * c("times")) / F.sum(c("n") * c("times"))).alias("m")
    )
    tail = (1.0 - level) / 2.0
    # `reps` values per scheme at most
    ends = means.groupBy("scheme").agg(
        F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1.0 - tail).alias("ci_high")
    )
    actual = blocks.groupBy("scheme").agg((F.sum("total") / F.sum("n")).alias("mean"), F.max("n_blocks").alias("n_blocks"))
    return actual.join(ends, "scheme").withColumn("excludes_zero", (c("ci_low") > 0) | (c("ci_high") < 0))


def drawn_values(draws: DataFrame, numbered: DataFrame, value: str) -> DataFrame:
    """Draws (`idx` in a capture and bin, `share` of the replicates) with the value of the name of that number.

    Draws fan out from a few counts, by which Spark would judge them small and broadcast them. They were dealt out by
    capture, bin and share before (`dealt`), and the values of a bin meet them there as one array in the order of
    the numbers, 8 bytes a name, on the hash side of the join: no draw is shuffled, sorted or broadcast.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("idx", value))), lambda x: x[value])
    names = numbered.groupBy("as_of", "bin").agg(listed.alias("_values")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = draws.join(names.hint("shuffle_hash"), ["as_of", "bin", "share"])
    return met.withColumn(value, F.get("_values", F.col("idx").cast("int"))).drop("_values")


def dealt(wanted: DataFrame, reps: int, parts: int) -> DataFrame:
    """Counts per (scheme, capture, bin), once a replicate (`rep`), where the values of their bin will be: the counts are few, the draws many."""
    each = wanted.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("share", F.col("rep") % SHARES)
    return each.repartition(parts, "as_of", "bin", "share")


def random_entry_null(universe: DataFrame, members: DataFrame, drift: str, value: str, bins: int = 5, reps: int = 99, seed: int = 11) -> DataFrame:
    """p-value of each scheme against random entries with the same drift bins and captures.

    `universe` has one row per (as_of, ticker) with drift and value; `members` has scheme, as_of,
    ticker. Names of a (capture, bin) are numbered once; a replicate then draws numbers (with
    replacement), so the work is replicates times entries, not replicates times names. The smallest
    p-value is 1 / (reps + 1); it must stay below the first threshold of `bh_fdr`, q / N_SCHEMES.
    """
    c = F.col
    pool = universe.where(c(drift).isNotNull() & c(value).isNotNull()).select("as_of", "ticker", drift, value)
    ranks = ranked_values(pool, ["as_of"], drift)
    binned = pool.join(
        ranks.select("as_of", drift, F.floor(c("n_below") * bins / c("n_total")).cast("int").alias("bin")), ["as_of", drift]
    )
    # stored: entries, draws and replicate means all read the numbering
    numbered = stored(scattered_index(binned.select("as_of", "bin", "ticker", value), ["as_of", "bin"], "ticker"), "pool")
    picked = members.select("scheme", "as_of", "ticker").join(numbered, ["as_of", "ticker"])
    actual = picked.groupBy("scheme").agg(F.avg(value).alias("actual"), F.count(F.lit(1)).alias("entries"))
    wanted = picked.groupBy("scheme", "as_of", "bin").agg(F.count(F.lit(1)).alias("k"), F.max("group_n").alias("group_n"))
    draws = (
        dealt(wanted, reps, spread(universe))
        .withColumn("j", F.explode(F.sequence(F.lit(1), c("k").cast("int"))))
        .withColumn("idx", draw(c("group_n"), F.lit(seed), c("scheme"), c("as_of"), c("bin"), c("rep"), c("j")))
    )
    null = (
        drawn_values(draws, numbered, value)
        .groupBy("scheme", "rep")
        .agg(F.avg(value).alias("m"))
    )
    return (
        null.join(actual, "scheme")
        .groupBy("scheme", "actual", "entries")
        .agg(F.count(F.lit(1)).alias("reps"), F.avg("m").alias("null_mean"), F.count_if(c("m") >= c("actual")).alias("_hits"))
        .withColumn("p_value", (c("_hits") + 1) / (c("reps") + 1))
        .drop("_hits")
    )


def bh_fdr(tests: DataFrame, q: float = 0.10, m: int = N_SCHEMES) -> DataFrame:
    """Benjamini-Hochberg keep flag among `m` schemes, counting those without a pick. Tests are few (one per scheme)."""
    w = Window.orderBy("p_value", "scheme")
    ranked = tests.withColumn("p_rank", F.row_number().over(w)).withColumn("threshold", F.col("p_rank") * q / m)
    limit = F.max(F.when(F.col("p_value") <= F.col("threshold"), F.col("p_rank"))).over(Window.partitionBy())
    return ranked.withColumn("keep", F.coalesce(F.col("p_rank") <= limit, F.lit(False)))


def sign_stability(est: DataFrame, primary: str = "1m", others: tuple[str, ...] = ("1w", "3m")) -> DataFrame:
    """Whether the context horizons share the sign of the primary estimate."""
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("mean")))
    wide = est.groupBy("scheme").agg(*[at(h).alias(f"mean_{h}") for h in (primary, *others)])
    same = F.lit(True)
    for h in others:
        same = same & (F.signum(f"mean_{h}") == F.signum(f"mean_{primary}"))
    return wide.withColumn("sign_stable", F.coalesce(same, F.lit(False)))


def normal_cdf(z: Column) -> Column:
    upper = sg.two_sided_normal_p(z) / 2.0
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def expected_peak(trials: int) -> float:
    """Expected maximum of that many standard normals."""
    inv = NormalDist().inv_cdf
    return (1 - EULER) * inv(1 - 1 / trials) + EULER * inv(1 - 1 / (trials * math.e))


def deflated_sharpe(series: DataFrame, trials: int = N_SCHEMES) -> DataFrame:
    """Sharpe ratio of each scheme's per-capture series deflated for `trials` schemes."""
    c = F.col
    peak = expected_peak(trials)
    m = series.groupBy("scheme").agg(
        F.count(F.lit(1)).alias("t"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"),
        F.skewness("r").alias("skew"), (F.kurtosis("r") + 3.0).alias("kurt"),
    ).withColumn("sharpe", F.try_divide(c("mu"), c("sd")))
    spread = F.stddev_samp("sharpe").over(Window.partitionBy())
    scale = F.sqrt(1.0 - c("skew") * c("sharpe") + (c("kurt") - 1.0) / 4.0 * c("sharpe") * c("sharpe"))
    return (
        m.withColumn("sharpe_floor", spread * F.lit(peak))
        .withColumn("dsr", normal_cdf((c("sharpe") - c("sharpe_floor")) * F.sqrt(c("t") - 1.0) / scale))
        .select("scheme", "t", "sharpe", "sharpe_floor", "dsr")
    )


def effective_trials(series: DataFrame) -> DataFrame:
    """Effective number of schemes from the mean pairwise correlation of their series.

    Rows are (scheme, capture): the pairs are scheme pairs, ten of them.
    """
    a = series.select("capture_ord", F.col("scheme").alias("a"), F.col("r").alias("ra"))
    b = series.select("capture_ord", F.col("scheme").alias("b"), F.col("r").alias("rb"))
    rho = a.join(b, "capture_ord").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"))
    n = series.agg(F.count_distinct("scheme")).scalar()
    return rho.agg(F.avg("rho").alias("mean_rho")).withColumn("n", n).withColumn(
        "effective_n", F.lit(1.0) + (F.col("n") - 1) * (1.0 - F.col("mean_rho"))
    )


def verdicts(ci: DataFrame, fdr: DataFrame, signs: DataFrame, dsr: DataFrame, captures: int | Column, cohorts: int | Column) -> DataFrame:
    """Eligibility, KEEP and graduation columns per scheme."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    c = F.col
    joined = (
        ci.select("scheme", "mean", "ci_low", "ci_high", "excludes_zero")
        .join(fdr.select("scheme", c("keep").alias("survives_null")), "scheme")
        .join(signs.select("scheme", "sign_stable"), "scheme")
        .join(dsr.select("scheme", "dsr"), "scheme")
    )
    return (
        joined.withColumn("eligible", (lit(captures) >= 26) & (lit(cohorts) >= 20))
        .withColumn("keep", c("excludes_zero") & c("survives_null") & c("sign_stable"))
        .withColumn("graduates", F.coalesce(c("eligible") & c("keep") & (c("mean") >= 0.0025) & (c("dsr") >= 0.90), F.lit(False)))
    )


def paper_track(series: DataFrame, weeks: int = 13) -> DataFrame:
    """Live check of a graduated scheme over its first `weeks` captures."""
    w = Window.partitionBy("scheme").orderBy("capture_ord")
    first = series.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= weeks)
    return first.groupBy("scheme").agg(F.count(F.lit(1)).alias("captures"), F.avg("r").alias("net_alpha")).withColumn(
        "passes", (F.col("captures") == weeks) & (F.col("net_alpha") >= 0)
    )


def regrade(series: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Cumulative grade at every quarterly cut-off.

    `series` is one row per (scheme, capture); running sums replace a join of cut-offs with all
    earlier captures.
    """
    w = Window.partitionBy("scheme").orderBy("as_of").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marks = series.select("scheme", "as_of", "r", F.lit(False).alias("cut")).unionByName(
        series.select("scheme").distinct().withColumn(
            "as_of", F.explode(cutoffs.agg(F.collect_set("cutoff")).scalar())
        ).select("scheme", "as_of", F.lit(None).cast("double").alias("r"), F.lit(True).alias("cut"))
    )
    return (
        marks.withColumn("captures", F.count("r").over(w))
        .withColumn("mean", F.avg("r").over(w))
        .where("cut AND captures > 0")
        .select("scheme", F.col("as_of").alias("cutoff"), "captures", "mean")
    )

