"""Grading of schemes on realised returns: retained books, net style-neutral series, and states that grade any cut-off.

The states are kept per (scheme, capture) and are additive in time: weighted sums for the bootstrap, sums per
replicate of the null, moments of the series. A grade at a cut-off is a running sum up to it, so the
quarterly re-grade reads each capture once and redraws nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators import inference as inf
from panelflow.operators import portfolio as pf
from panelflow.operators import schemes as sc
from panelflow.operators.ordered import ranked_values, scattered_index
from panelflow.session import attach, stored

SCHEMES = ("S1a", "S1b", "S1c", "S2", "S3")
REPLICATES = 2000
NULL_REPLICATES = 199
DRIFT_BINS = 5
# ---- fixed values of the framework ----------------------------------------------------------
MIN_CAPTURES, MIN_COHORTS, INTERIM_CAPTURES = 26, 20, 8
NET_BAR, DSR_BAR = 0.0025, 0.90
HORIZON_MONTHS = {"1w": 0, "1m": 1, "3m": 3}

PRIME = 2_147_483_647
ROUNDS = 12


# ---- members, books, net series --------------------------------------------------------------


def neutral_alphas(rows: DataFrame, horizons: tuple[str, ...] = ("1w", "1m", "3m")) -> DataFrame:
    """Rows with `neutral_<horizon>`: drift-adjusted alphas less what style explains in the capture."""
    for h in horizons:
        rows = sc.style_residual(rows, f"alpha_{h}", f"neutral_{h}")
    return rows


def retained_members(rows: DataFrame) -> DataFrame:
    """Cohorts of the five schemes with retention: one row per (scheme, capture, name).

    S1c and S2 keep a maturing name while it stays inside twice the entry threshold (180 names in whole score
    classes, two deciles); S1a, S1b and S3 take names on a fresh event only.
    """
    keep = list(rows.columns)
    floor = sc.SCORE_CLASS_FLOOR
    classes = sc.score_classes(rows, 2 * floor).select("as_of", "smart_score", (F.col("n_above") < floor).alias("_enters"))
    ranked = sc.top_share(sc.composite(rows), "composite_residual", 0.20).withColumn("_enters", F.col("rank_share") < 0.10)
    bands = {"S1c": attach(rows, classes, ["as_of", "smart_score"], "inner"), "S2": ranked}
    parts = {"S1a": sc.rating_change(rows), "S1b": sc.target_raise(rows), "S3": sc.gated(rows)}
    parts |= {name: pf.retained(band, "_enters") for name, band in bands.items()}
    out = [df.select(F.lit(name).alias("scheme"), *keep) for name, df in sorted(parts.items())]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


def retained_top(rows: DataFrame, value: str, top: int = 20, per_sector: int = 5) -> DataFrame:
    """Top view with retention: names enter inside the capped top and stay inside the capped top of twice the size."""
    wide = pf.capped_top(rows, value, 2 * top, per_sector)
    narrow = pf.capped_top(rows, value, top, per_sector).select("as_of", "ticker", F.lit(True).alias("_enters"))
    return pf.retained(wide.join(narrow, ["as_of", "ticker"], "left").withColumn("_enters", F.coalesce("_enters", F.lit(False))), "_enters")


def book_costs(members: DataFrame, rows: DataFrame, last_ord) -> DataFrame:
    """Turnover and costs per book; retained names trade the change of their weight only, at the day's dollar volume."""
    book = stored(pf.cohort_weights(members.select("scheme", "capture_ord", "ticker", "adv_usd"), last_ord), "retained-books")
    return pf.costs(pf.on_trade_day(pf.trades(book, last_ord), rows))


def net_series(members: DataFrame, costs: DataFrame, life: int = pf.COHORT_LIFE) -> DataFrame:
    """Per (scheme, capture): names, gross and net style-neutral alpha of the cohort, and the means of the other horizons.

    A cohort is 1 / life of the book, so the book's cost of a capture weighs `life` times on the cohort formed then.
    """
    gross = members.groupBy("scheme", "capture_ord", "as_of").agg(
        F.count("neutral_1m").alias("names"), F.avg("neutral_1m").alias("gross"),
        F.avg("neutral_1w").alias("gross_1w"), F.avg("neutral_3m").alias("gross_3m"))
    bps = costs.select("scheme", F.col("book_ord").alias("capture_ord"), "tiered_bps")
    cost = F.coalesce("tiered_bps", F.lit(0.0)) * life
    return gross.join(bps, ["scheme", "capture_ord"], "left").select(
        "scheme", "capture_ord", "as_of", "names", "gross", "gross_1w", "gross_3m", cost.alias("cost_bps"),
        (F.col("gross") - cost / 10_000.0).alias("net"))


# ---- bootstrap ---------------------------------------------------------------------------------


def poisson(digest: Column) -> Column:
    """Poisson(1) count from the first 32 bits of a hex digest."""
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    share, total, out = math.exp(-1), 0.0, F.lit(0)
    for k in range(8):
        total += share
        out = out + (u >= F.lit(int(total * 2 ** 32))).cast("int")
        share /= k + 1
    return out.cast("tinyint")


def block_weights(blocks: DataFrame, reps: int = REPLICATES, seed: int = 7) -> DataFrame:
    """(block, weights): how often each replicate draws a time block, as one array per block.

    Independent Poisson(1) counts stand for draws with replacement; they need no number of blocks, so sums over
    blocks can be carried forward in time.
    """
    one = lambda r: poisson(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("block").cast("string"), r.cast("string"))))
    return blocks.select("block").distinct().withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), one))


def replicate_interval(held: Column, reps: int, level: float) -> tuple[Column, Column]:
    """Ends of the percentile interval of the replicate means of a list of (value, weights)."""
    def mean(r: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
        add = lambda acc, x: F.struct((acc["s"] + x["value"] * F.get(x["weights"], r)).alias("s"), (acc["n"] + F.get(x["weights"], r)).alias("n"))
        return F.aggregate(held, start, add, lambda acc: F.try_divide(acc["s"], acc["n"]))

    means = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), mean), lambda m: m.isNotNull()))
    def end(p: float) -> Column:
        def of(m: Column) -> Column:
            at = (F.size(m) - 1) * F.lit(p)
            low, high = F.get(m, F.floor(at).cast("int")), F.get(m, F.ceil(at).cast("int"))
            return low + (high - low) * (at - F.floor(at))
        return F.get(F.transform(F.array(means), of), F.lit(0))
    tail = (1.0 - level) / 2.0
    return end(tail), end(1.0 - tail)


def marked(series: DataFrame, cutoffs: DataFrame, on: str, *keys: str) -> DataFrame:
    """Rows of the series with their date as `_at`, and one row per key and cut-off with `_cut` that follows all rows up to it."""
    days = cutoffs.agg(F.collect_set("cutoff")).scalar()
    cuts = series.select(*keys).distinct().withColumn("_at", F.explode(days)).withColumn("_cut", F.lit(True))
    return series.withColumn("_at", F.col(on)).withColumn("_cut", F.lit(False)).unionByName(cuts, allowMissingColumns=True)


def running(*keys: str):
    """All rows of the key up to a cut-off; a key has one row per capture, so the calendar bounds it."""
    return Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def bootstrap(series: DataFrame, cutoffs: DataFrame, life: int = pf.COHORT_LIFE, reps: int = REPLICATES, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Mean of the net series with its block bootstrap interval, per (scheme, cut-off), over cohorts matured by then."""
    c = F.col
    held = series.where("net IS NOT NULL").withColumn("block", F.floor((c("capture_ord") - 1) / life).cast("int"))
    weighted = held.join(block_weights(held, reps, seed), "block")
    w = running("scheme")
    states = marked(weighted.select("scheme", "known_on", "net", "block", F.struct(c("net").alias("value"), "weights").alias("one")), cutoffs, "known_on", "scheme")
    states = states.withColumns({
        "list": F.collect_list("one").over(w), "cohorts": F.count("net").over(w), "mean": F.avg("net").over(w),
        "blocks": F.size(F.collect_set("block").over(w)),
    }).where("_cut AND cohorts > 0").select("scheme", c("_at").alias("cutoff"), "cohorts", "blocks", "mean", "list")
    # few rows with much to compute in each: one task a row
    spread = states.repartition(inf.spread(series), "scheme", "cutoff")
    low, high = replicate_interval(c("list"), reps, level)
    out = spread.select("scheme", "cutoff", "cohorts", "blocks", "mean", low.alias("ci_low"), high.alias("ci_high"))
    return out.withColumn("excludes_zero", F.coalesce((c("ci_low") > 0) | (c("ci_high") < 0), F.lit(False)))


# ---- random-entry null -------------------------------------------------------------------------


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Image of i under a permutation of 0 .. n - 1 that the 60-bit key chooses.

    Swap or not: each round pairs x with a partner k - x (mod n) and a bit of the pair's larger member says whether they
    change places, so every round, hence the whole, is one to one for any n.
    """
    return in_rounds(i, n, rounds(n, key))


def rounds(n: Column, key: Column) -> Column:
    """What each round needs of the key: two multipliers and the sum of a pair (mod n). Worked out once a key, not once a draw."""
    p = F.lit(PRIME)
    low, high = key % p, F.shiftright(key, 29) % p

    def one(j: Column) -> Column:
        r, s = (low + j * 1_000_003) % p, (high + j * 7919) % p
        return F.struct(r.alias("r"), s.alias("s"), ((r * s) % p % n).alias("k"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(ROUNDS - 1).cast("bigint")), one)


def in_rounds(i: Column, n: Column, each: Column) -> Column:
    """Image of i under the rounds of a key."""
    p = F.lit(PRIME)

    def step(x: Column, e: Column) -> Column:
        partner = (e["k"] - x + n) % n
        top = F.greatest(x, partner)
        bit = F.shiftright(((top * 48_271 + e["r"]) % p) * ((top * 69_621 + e["s"]) % p) % p, 12) % 2
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(each, i.cast("bigint"), step)


def in_columns(draws: DataFrame, count: str, n: str, key: Column) -> DataFrame:
    """The rows of `draws`, each once for every number below `count`, with the number's image `idx` under the permutation of 0 .. n - 1.

    Same images as `permuted`, for n below 2 ** 31. What the rounds need of the key is worked out before the rows fan out, and a
    round is two steps of plain columns that are never null, which Spark compiles (in one method, which the JVM leaves alone
    beyond 8,000 bytes): a lambda over an array is interpreted for every draw. Remainders of PRIME, which is 2 ** 31 - 1, are sums
    of a number's low and high bits.
    """
    c, p, one = F.col, F.lit(PRIME).cast("bigint"), F.lit(1).cast("bigint")
    never_null = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    folded = lambda v: v.bitwiseAND(p) + F.shiftright(v, 31)
    kept = draws.columns
    low, high = key % p, F.shiftright(key, 29) % p
    names = [[f"_{x}{j}" for j in range(ROUNDS)] for x in "rsk"]
    draws = draws.select(*kept, *[never_null((low + j * 1_000_003) % p).alias(r) for j, r in enumerate(names[0])],
                         *[never_null((high + j * 7919) % p).alias(s) for j, s in enumerate(names[1])])
    draws = draws.withColumns({k: never_null((c(r) * c(s)) % p % c(n)) for r, s, k in zip(*names)})
    draws = draws.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), c(count) - 1)))
    # n where the partner k - x lies below 0
    wrap = lambda x, k: F.shiftright(c(k) - x, 63).bitwiseAND(c(n))
    draws = draws.withColumn("_wrap", wrap(c("idx"), names[2][0]))
    for r, s, k, after in zip(*names, [*names[2][1:], None]):
        x = c("idx")
        step = c(k) - x + c("_wrap") - x  # leads to the partner; the larger of the two decides
        top = x + step - step.bitwiseAND(F.shiftright(step, 63))
        product = folded(top * 48_271 + c(r)) * folded(top * 69_621 + c(s))
        draws = draws.withColumns({"_step": step, "_low": product.bitwiseAND(p), "_high": F.shiftright(product, 31)})
        twice = folded(c("_low") + c("_high"))  # at most PRIME + 2
        bit = F.shiftright(twice + F.shiftright(twice + 1, 31), 12).bitwiseAND(one)
        image = x + c("_step") * bit
        draws = draws.withColumns({"idx": image, "_wrap": wrap(image, after)} if after else {"idx": image})
        draws = draws.drop("_step", "_low", "_high", r, s, k)
    return draws.drop("_wrap")


def null_states(rows: DataFrame, members: DataFrame, drift: str = "drift_per_session", value: str = "neutral_1m",
                bins: int = DRIFT_BINS, reps: int = NULL_REPLICATES, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Sums of the members' values per (scheme, capture), and of as many random entries per (scheme, capture, replicate).

    Random entries come from the same capture and drift bin, without replacement: names of a bin are numbered,
    and a replicate takes the images of 0 .. k - 1 under its own permutation of the numbers. Nothing is
    sorted per replicate; the work is replicates times entries.
    """
    c = F.col
    pool = rows.where(c(drift).isNotNull() & c(value).isNotNull()).select("as_of", "capture_ord", "ticker", drift, c(value).alias("value"))
    ranks = ranked_values(pool, ["as_of"], drift)
    binned = pool.join(
        ranks.select("as_of", drift, F.floor(c("n_below") * bins / c("n_total")).cast("int").alias("bin")), ["as_of", drift])
    numbered = stored(scattered_index(binned.select("as_of", "capture_ord", "bin", "ticker", "value"), ["as_of", "bin"], "ticker"), "null-pool")
    picked = members.select("scheme", "as_of", "ticker").join(numbered, ["as_of", "ticker"])
    actual = picked.groupBy("scheme", "as_of", "capture_ord").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    # never null, so that no draw is asked for a null check
    most = F.coalesce(F.max("group_n"), F.lit(0)).alias("group_n")
    wanted = picked.groupBy("scheme", "as_of", "bin").agg(F.count(F.lit(1)).alias("k"), most)
    coordinates = [F.lit(seed), c("scheme"), c("as_of"), c("bin"), c("rep")]
    key = F.conv(F.substring(F.md5(F.concat_ws("-", *[x.cast("string") for x in coordinates])), 1, 15), 16, 10).cast("bigint")
    draws = in_columns(inf.dealt(wanted, reps, inf.spread(rows)), "k", "group_n", F.coalesce(key, F.lit(0))).drop("k", "group_n")
    null = inf.drawn_values(draws, numbered, "value").groupBy("scheme", "as_of", "rep").agg(
        F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return stored(actual, "null-actual"), stored(null, "null-states")


def null_tests(actual: DataFrame, null: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Actual mean, mean of the null and p-value per (scheme, cut-off), from states carried forward.

    Means are compared at ten decimals, so that a draw of a whole bin counts as equal in any order of summing.
    """
    c = F.col
    known = lambda df: df.withColumn("known_on", F.add_months("as_of", HORIZON_MONTHS["1m"]))
    def upto(df: DataFrame, *keys: str) -> DataFrame:
        w = running(*keys)
        sums = marked(known(df).select(*keys, "known_on", "s", "n"), cutoffs, "known_on", *keys).withColumns({"_s": F.sum("s").over(w), "_n": F.sum("n").over(w)})
        return sums.where("_cut AND _n > 0").select(*keys, c("_at").alias("cutoff"), (c("_s") / c("_n")).alias("m"), c("_n").alias("entries"))

    real = upto(actual, "scheme").select("scheme", "cutoff", c("m").alias("actual"), "entries")
    drawn = upto(null, "scheme", "rep").drop("entries")
    return drawn.join(real, ["scheme", "cutoff"]).groupBy("scheme", "cutoff", "actual", "entries").agg(
        F.count(F.lit(1)).alias("reps"), F.avg("m").alias("null_mean"),
        ((F.count_if(F.round("m", 10) >= F.round("actual", 10)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


# ---- verdicts ----------------------------------------------------------------------------------


def survives(tests: DataFrame, q: float = 0.10, m: int = inf.N_SCHEMES) -> DataFrame:
    """Benjamini-Hochberg among the schemes of a cut-off (five rows)."""
    rank = F.row_number().over(Window.partitionBy("cutoff").orderBy("p_value", "scheme"))
    ranked = tests.withColumn("_rank", rank).withColumn("_limit", F.max(
        F.when(F.col("p_value") <= F.col("_rank") * q / m, F.col("_rank"))).over(Window.partitionBy("cutoff")))
    return ranked.withColumn("survives_null", F.coalesce(F.col("_rank") <= F.col("_limit"), F.lit(False))).drop("_rank", "_limit")


def signs(series: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Whether the 1-week and 3-month means share the sign of the 1-month mean, each over what had matured by the cut-off."""
    c, w = F.col, running("scheme")
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), c(v).alias("v"), F.when(F.lit(h == "1w"), F.date_add("as_of", 7)).otherwise(F.add_months("as_of", m)).alias("at"))
                      for (h, m), v in zip(HORIZON_MONTHS.items(), ("gross_1w", "gross", "gross_3m"))])
    long = series.select("scheme", F.inline(cells)).where("v IS NOT NULL")
    rows = marked(long, cutoffs, "at", "scheme")
    rows = rows.withColumns({f"m_{h}": F.avg(F.when(c("horizon") == h, c("v"))).over(w) for h in HORIZON_MONTHS})
    same = (F.signum("m_1w") == F.signum("m_1m")) & (F.signum("m_3m") == F.signum("m_1m"))
    return rows.where("_cut").select("scheme", c("_at").alias("cutoff"), F.coalesce(same, F.lit(False)).alias("sign_stable"))


def sharpe(series: DataFrame, cutoffs: DataFrame, trials: int = inf.N_SCHEMES) -> DataFrame:
    """Deflated Sharpe ratio of the net series per (scheme, cut-off) from running moments."""
    c, w = F.col, running("scheme")
    rows = marked(series.where("net IS NOT NULL").select("scheme", "known_on", "net"), cutoffs, "known_on", "scheme").withColumns({
        "t": F.count("net").over(w), "mu": F.avg("net").over(w), "sd": F.stddev_samp("net").over(w),
        "skew": F.skewness("net").over(w), "kurt": F.kurtosis("net").over(w) + 3.0,
    }).where("_cut AND t > 0").withColumn("sharpe", F.try_divide(c("mu"), c("sd")))
    floor = F.stddev_samp("sharpe").over(Window.partitionBy("_at")) * F.lit(inf.expected_peak(trials))
    scale = F.sqrt(1.0 - c("skew") * c("sharpe") + (c("kurt") - 1.0) / 4.0 * c("sharpe") * c("sharpe"))
    z = (c("sharpe") - floor) * F.sqrt(c("t") - 1.0) / scale
    return rows.select("scheme", c("_at").alias("cutoff"), inf.normal_cdf(z).alias("dsr"))


def graded(series: DataFrame) -> DataFrame:
    """The net series with the day each cohort's 1-month outcome is known."""
    return series.withColumn("known_on", F.add_months("as_of", HORIZON_MONTHS["1m"]))


def verdicts(series: DataFrame, actual: DataFrame, null: DataFrame, captures: DataFrame, cutoffs: DataFrame, reps: int = REPLICATES) -> DataFrame:
    """Every verdict column per (scheme, cut-off), and the standing that follows from the verdicts so far.

    `captures` counts the captures up to the cut-off, `cohorts` those whose outcome was known. A graduated scheme that
    later misses the bar is on monitor.
    """
    c = F.col
    series = graded(series)
    # one row per capture and cut-off
    seen = marked(captures.select(F.lit(1).alias("_k"), "as_of", F.lit(1).alias("one")), cutoffs, "as_of", "_k").withColumn(
        "captures", F.sum("one").over(running("_k"))).where("_cut").select(c("_at").alias("cutoff"), "captures")
    rows = (
        bootstrap(series, cutoffs, reps=reps).join(survives(null_tests(actual, null, cutoffs)).select("scheme", "cutoff", "p_value", "survives_null"), ["scheme", "cutoff"], "left")
        .join(signs(series, cutoffs), ["scheme", "cutoff"], "left")
        .join(sharpe(series, cutoffs), ["scheme", "cutoff"], "left")
        .join(seen, "cutoff", "left")
    )
    rows = rows.withColumn("eligible", (c("captures") >= MIN_CAPTURES) & (c("cohorts") >= MIN_COHORTS))
    rows = rows.withColumn("keep", F.coalesce(c("excludes_zero") & c("survives_null") & c("sign_stable"), F.lit(False)))
    bar = F.coalesce((c("mean") >= NET_BAR) & (c("dsr") >= DSR_BAR), F.lit(False))
    rows = rows.withColumn("graduates", c("eligible") & c("keep") & bar)
    before = F.coalesce(F.bool_or("graduates").over(Window.partitionBy("scheme").orderBy("cutoff").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    standing = (
        F.when(c("captures") < INTERIM_CAPTURES, "accruing").when(~c("eligible"), "interim")
        .when(before & ~c("keep"), "monitor").when(before | c("graduates"), "graduated").when(c("keep"), "kept").otherwise("dropped")
    )
    return rows.withColumn("standing", standing)

