"""Grading on realised returns: permutation, replicate weights, retention, states against a pass from scratch."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelflow.operators import grading as gr
from panelflow.operators import inference as inf
from panelflow.operators import portfolio as pf
from panelflow.operators import returns as rt
from panelflow.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_the_keyed_permutation_is_one_to_one_and_even(spark):
    sizes = [1, 2, 3, 7, 64, 101]
    keys = [3, 2 ** 59 + 12345, 987654321987]
    rows = [(n, k, i) for n in sizes for k in keys for i in range(n)]
    df = spark.createDataFrame(rows, "n long, k long, i long").withColumn("x", gr.permuted(F.col("i"), F.col("n"), F.col("k")))
    for n in sizes:
        for k in keys:
            assert sorted(r.x for r in df.where(f"n = {n} AND k = {k}").collect()) == list(range(n))
    # the first five of fifty are drawn about equally often over many keys, also in pairs
    many = spark.range(4000).select(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("i"))
    hits = {r.x: r.n for r in many.groupBy(gr.permuted(F.col("i"), F.lit(50).cast("bigint"), F.col("k")).alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(hits) == 50 and max(abs(n - 400) for n in hits.values()) < 100
    sets = many.groupBy("k").agg(F.collect_list(gr.permuted(F.col("i"), F.lit(50).cast("bigint"), F.col("k"))).alias("s"))
    both = sets.where("array_contains(s, 7) AND array_contains(s, 33)").count()
    assert abs(both / 4000 - 5 * 4 / (50 * 49)) < 0.005


def test_replicate_weights_are_poisson(spark):
    w = gr.block_weights(spark.range(20).select(F.col("id").cast("int").alias("block")), 2000)
    got = w.select(F.explode("weights").alias("w")).groupBy("w").count().collect()
    assert sum(r["count"] for r in got) == 40_000
    for r in got:
        assert abs(r["count"] / 40_000 - math.exp(-1) / math.factorial(r.w)) < 0.01


def test_retention_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(t, c, rng.random() < 0.3) for t in "abcdef" for c in range(1, 60) if rng.random() < 0.7]
    held, want = {}, set()
    for t, c, enters in sorted(rows, key=lambda r: r[1]):
        held[t, c] = enters or held.get((t, c - 4), False)
        if held[t, c]:
            want.add((t, c))
    got = pf.retained(spark.createDataFrame(rows, "ticker string, capture_ord int, enters boolean"), "enters").collect()
    assert {(r.ticker, r.capture_ord) for r in got} == want and 0 < len(want) < len(rows)


def series_of(spark, n=40, seed=2):
    rng = random.Random(seed)
    day = lambda i: dt.date(2020, 1, 6) + dt.timedelta(days=7 * i)
    rows = [(s, i, day(i), 5, v, v / 3 + 0.001, v * 2, 4.0, v - 0.0004) for s, m in (("S1a", 0.01), ("S2", 0.0)) for i in range(1, n) for v in [rng.gauss(m, 0.01)]]
    return spark.createDataFrame(rows, "scheme string, capture_ord int, as_of date, names int, gross double, gross_1w double, gross_3m double, cost_bps double, net double")


def cuts(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "cutoff date")


def test_a_cut_off_sees_what_a_pass_from_scratch_sees(spark):
    """States carried forward grade each cut-off as if only the cohorts matured by then existed."""
    series = gr.graded(series_of(spark))
    days = [dt.date(2020, 5, 1), dt.date(2020, 9, 30)]
    together = {(r.scheme, r.cutoff): r for r in gr.bootstrap(series, cuts(spark, *days), reps=200).collect()}
    sharpes = {(r.scheme, r.cutoff): r.dsr for r in gr.sharpe(series, cuts(spark, *days)).collect()}
    for day in days:
        part = series.where(F.col("known_on") <= F.lit(day))
        for r in gr.bootstrap(part, cuts(spark, dt.date(2030, 1, 1)), reps=200).collect():
            other = together[r.scheme, day]
            assert (r.cohorts, r.blocks) == (other.cohorts, other.blocks)
            assert all(abs(r[c] - other[c]) < 1e-12 for c in ("mean", "ci_low", "ci_high"))
        for r in gr.sharpe(part, cuts(spark, dt.date(2030, 1, 1))).collect():
            assert abs(r.dsr - sharpes[r.scheme, day]) < 1e-9


def test_the_interval_covers_like_the_normal_one(spark):
    series = gr.graded(series_of(spark, 400, 9))
    for r in gr.bootstrap(series, cuts(spark, dt.date(2040, 1, 1))).collect():
        values = [x.net for x in series.where(F.col("scheme") == r.scheme).collect()]
        mean = sum(values) / len(values)
        se = (sum((v - mean) ** 2 for v in values) / (len(values) - 1) / len(values)) ** 0.5
        assert abs((r.ci_high - r.ci_low) / (2 * 1.96 * se) - 1) < 0.15 and abs(r.mean - mean) < 1e-12


def test_the_null_takes_distinct_names_of_the_same_bin(spark):
    rng = random.Random(1)
    day = dt.date(2020, 1, 6)
    rows = [(day, 1, f"t{i}", i / 100, 0.02 if i < 20 else rng.gauss(0, 0.01)) for i in range(100)]
    df = spark.createDataFrame(rows, "as_of date, capture_ord int, ticker string, drift_per_session double, neutral_1m double")
    members = df.where("drift_per_session < 0.2").selectExpr("'S1a' AS scheme", "as_of", "ticker")  # the whole first bin
    some = df.where("drift_per_session >= 0.2 AND drift_per_session < 0.25").selectExpr("'S2' AS scheme", "as_of", "ticker")
    got = {r.scheme: r for r in gr.null_tests(*gr.null_states(df, members.unionByName(some)), cuts(spark, dt.date(2021, 1, 1))).collect()}
    # without replacement a draw as large as the bin is the bin: the null never lies below
    assert got["S1a"].p_value == 1.0 and abs(got["S1a"].null_mean - 0.02) < 1e-12 and got["S1a"].entries == 20
    assert 1 / 200 <= got["S2"].p_value <= 1 and got["S2"].reps == 199


@pytest.mark.parametrize("module", [gr, inf])
def test_draws_of_a_null_are_never_broadcast(spark, monkeypatch, module):
    """A few counts fan out into replicates times entries: Spark would take them for small and collect them in the driver."""
    monkeypatch.setattr(module, "stored", lambda df, _: df)
    rng = random.Random(2)
    rows = [(dt.date(2020, 1, 6), 1, f"t{i}", i / 100, rng.gauss(0, 0.01)) for i in range(100)]
    df = spark.createDataFrame(rows, "as_of date, capture_ord int, ticker string, drift_per_session double, neutral_1m double")
    members = df.where("drift_per_session < 0.3").selectExpr("'S1a' AS scheme", "as_of", "ticker")
    joins = []
    monkeypatch.setattr(inf, "drawn_values", lambda draws, numbered, value, f=inf.drawn_values: joins.append(f(draws, numbered, value)) or joins[-1])
    out = gr.null_states(df, members)[1] if module is gr else inf.random_entry_null(df, members, "drift_per_session", "neutral_1m")
    out.collect()
    assert len(joins[0].collect()) == 30 * (199 if module is gr else 99)
    assert "ShuffledHashJoin" in joins[0]._jdf.queryExecution().executedPlan().toString()


def test_standing_follows_graduation_and_demotion(spark):
    day = lambda i: dt.date(2020, 1, 6) + dt.timedelta(days=7 * i)
    value = lambda i: (0.012 if i < 40 else -0.03) + (0.001 if i % 2 else -0.001)
    rows = [("S1a", i, day(i), 5, value(i), value(i), value(i), 0.0, value(i)) for i in range(1, 70)]
    rows += [("S2", i, day(i), 5, 0.001 * (-1) ** i, 0.0, 0.0, 0.0, 0.001 * (-1) ** i) for i in range(1, 70)]
    series = spark.createDataFrame(rows, series_of(spark, 2).schema)
    state = lambda r, s: [("S1a", day(i), *([r] if r is not None else []), value(i) if s else 0.0, 1) for i in range(1, 70)]
    actual = spark.createDataFrame(state(None, True), "scheme string, as_of date, s double, n long")
    null = spark.createDataFrame([x for r in range(199) for x in state(r, False)], "scheme string, as_of date, rep int, s double, n long")
    captures = spark.createDataFrame([(i, day(i)) for i in range(1, 70)], "capture_ord int, as_of date")
    marks = [day(7), day(20), day(40), day(69)]
    got = {r.cutoff: r for r in gr.verdicts(series, actual, null, captures, cuts(spark, *marks), reps=200).where("scheme = 'S1a'").collect()}
    assert [got[d].standing for d in marks] == ["accruing", "interim", "graduated", "monitor"]
    assert got[marks[2]].keep and got[marks[2]].eligible and not got[marks[3]].keep
    assert got[marks[1]].captures == 20 and not got[marks[1]].eligible


def test_one_as_of_pass_equals_the_two_step_returns(spark):
    from panelflow.plans import catalogue as ct
    from panelflow.sources import driver_tables as dtb

    SF = "/root/testdata/sf0.01"  # the smallest tables hold too few bars for a beta
    bars, market = dtb.feed(spark, SF)
    old, oldm = dtb.bars(spark, SF), dtb.market_bars(spark, SF)
    assert bars.exceptAll(old.select("symbol", "session", "close")).isEmpty() and market.exceptAll(oldm.select("session", "close")).isEmpty()
    anchors = ct._anchors(bars, dtb.panel_captures(spark, SF))
    end = dtb.sessions(spark, SF).agg(F.max("session")).scalar()
    want = rt.drift_adjusted_returns(anchors, old, oldm, dtb.sessions(spark, SF), end, ["1w", "1m", "3m"]).where("alpha IS NOT NULL")
    got = rt.graded_returns(anchors, bars, market, end)
    long = got.select("symbol", "as_of", F.expr("stack(3, '1w', alpha_1w, '1m', alpha_1m, '3m', alpha_3m) AS (horizon, alpha)")).where("alpha IS NOT NULL")
    both = long.join(want.select("symbol", "as_of", "horizon", F.col("alpha").alias("b")), ["symbol", "as_of", "horizon"], "full")
    assert both.count() > 100 and both.where("alpha IS NULL OR b IS NULL OR abs(alpha - b) > 1e-9 * (1 + abs(b))").isEmpty()


def test_bars_and_market_come_from_one_scan_of_the_lines(spark, monkeypatch):
    from panelflow.sources import driver_tables as dtb

    seen = []
    real = dtb.table
    monkeypatch.setattr(dtb, "table", lambda s, d, n: (seen.append(n), real(s, d, n))[1])
    plan = QUERIES["graded_returns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert seen.count("lineitem") == 1 and "lineitem" not in plan
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"))


@pytest.mark.parametrize("name", ["retained_book_costs", "quarterly_verdicts"])
def test_plans_hold_no_pairs_of_rows_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"))


def test_compiled_rounds_draw_the_same_images_as_the_permutation(spark):
    sizes = [1, 2, 3, 64, 101, 5000, 2 ** 31 - 1]
    keys = [0, 3, 2 ** 60 - 1, 2 ** 59 + 12345, 987654321987]
    df = spark.createDataFrame([(n, min(n, 300), k) for n in sizes for k in keys], "n long, k long, key long").withColumn("n", F.coalesce("n", F.lit(0)))
    got = gr.in_columns(df, "k", "n", F.col("key")).collect()
    want = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("n", "key", gr.permuted(F.col("i"), F.col("n"), F.col("key")).alias("idx")).collect()
    assert sorted((r.n, r.key, r.idx) for r in got) == sorted((r.n, r.key, r.idx) for r in want)


@pytest.mark.parametrize("module", [gr, inf])
def test_draws_of_a_null_are_not_shuffled(spark, monkeypatch, module):
    """Only the counts are dealt out, and the names of a bin meet them as one array; the draws are compiled, not interpreted."""
    monkeypatch.setattr(module, "stored", lambda df, _: df)
    rows = [(dt.date(2020, 1, 6), 1, f"t{i}", i / 100, i / 7) for i in range(100)]
    df = spark.createDataFrame(rows, "as_of date, capture_ord int, ticker string, drift_per_session double, neutral_1m double")
    members = df.where("drift_per_session < 0.3").selectExpr("'S1a' AS scheme", "as_of", "ticker")
    met = []
    monkeypatch.setattr(inf, "drawn_values", lambda draws, numbered, value, f=inf.drawn_values: met.append((draws, f(draws, numbered, value))) or met[-1][1])
    gr.null_states(df, members) if module is gr else inf.random_entry_null(df, members, "drift_per_session", "neutral_1m")
    plan = met[0][1]._jdf.queryExecution().executedPlan().toString()
    # from the top: the join, the draws as they fan out, and only then what deals out the counts
    assert plan.index("ShuffledHashJoin") < plan.index("Generate") < plan.index("Exchange")
    assert "lambdafunction" not in plan[:plan.index("Generate")]
    name = "value" if module is gr else "neutral_1m"
    assert all(r[name] is not None for r in met[0][1].collect())
