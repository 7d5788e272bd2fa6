"""Schemes, portfolios and inference against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.operators import inference as inf
from panelflow.operators import portfolio as pf
from panelflow.operators import schemes as sc

D = dt.date


def test_retention_equals_sequential_rule(spark):
    rng = random.Random(2)
    rows = [(f"t{t}", o, rng.choice([0.03, 0.08, 0.12, 0.18, 0.25, 0.6])) for t in range(30) for o in range(1, 41) if rng.random() < 0.9]
    got = {(r["ticker"], r["capture_ord"]): r["held"] for r in pf.retention_band(spark.createDataFrame(rows, "ticker string, capture_ord int, rank_share double")).collect()}
    share = {(t, o): s for t, o, s in rows}
    for t in range(30):
        for lane in range(4):
            held = False
            for o in [o for o in range(1, 45) if o % 4 == lane]:
                s = share.get((f"t{t}", o))
                held = s is not None and s < 0.2 and (held or s < 0.1)
                if s is not None:
                    assert got[f"t{t}", o] == held, (t, o)


def test_capped_top_equals_greedy_pick(spark):
    rng = random.Random(8)
    rows = [(D(2026, 8, 1), i, rng.choice(["A", "B", "C", None]), float(rng.randint(0, 30))) for i in range(200)]
    got = [r["ticker"] for r in pf.capped_top(spark.createDataFrame(rows, "as_of date, ticker int, sector string, v double"), "v", 20, 6).orderBy("place").collect()]
    want, used = [], {}
    for _, t, s, v in sorted(rows, key=lambda r: (-r[3], r[1])):
        if used.get(s, 0) < 6 and len(want) < 20:
            want.append(t)
            used[s] = used.get(s, 0) + 1
    assert got == want


def test_score_bucket_keeps_tie_classes_whole(spark):
    rows = [(D(2026, 8, 1), i, 10.0 if i < 40 else 9.0 if i < 95 else 8.0) for i in range(120)] + [(D(2026, 8, 8), i, 10.0) for i in range(30)]
    df = spark.createDataFrame(rows, "as_of date, ticker int, smart_score double")
    got = {r["as_of"].day: r["n"] for r in sc.score_bucket(df).groupBy("as_of").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 95, 8: 30}


def test_style_residual_equals_dummy_regression(spark):
    rng = np.random.default_rng(6)
    n = 400
    sector = rng.choice(["A", "B", "C"], n, p=[0.7, 0.2, 0.1])
    cap, dy, beta = np.exp(rng.normal(22, 1, n)), np.where(rng.random(n) < 0.3, np.nan, rng.random(n)), rng.normal(1, 0.3, n)
    y = rng.normal(0, 1, n)
    df = spark.createDataFrame([(D(2026, 8, 1), i, str(s), float(a), None if np.isnan(b) else float(b), float(c), float(v))
                                for i, (s, a, b, c, v) in enumerate(zip(sector, cap, dy, beta, y))],
                               "as_of date, ticker int, sector string, market_cap double, dividend_yield double, beta double, y double").repartition(5)
    got = {r["ticker"]: r["residual"] for r in sc.style_residual(df, "y").collect()}
    x = np.column_stack([(sector == s).astype(float) for s in "ABC"] + [np.log(cap), np.nan_to_num(dy), beta])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert [got[i] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-7)
    assert abs(sum(got.values())) < 1e-6


def test_style_residual_drops_only_dead_controls(spark):
    rng = np.random.default_rng(9)
    n = 300
    size, beta = rng.normal(22, 1, n), rng.normal(1, 0.3, n)
    y = 2 * size - beta + rng.normal(0, 0.1, n)
    for dead in (np.full(n, 0.3), 5 - 2 * size):  # constant, and following from another control
        df = spark.createDataFrame([(D(2026, 8, 1), i, "A", *map(float, v)) for i, v in enumerate(zip(size, dead, beta, y))],
                                   "as_of date, ticker int, sector string, s double, d double, b double, y double").repartition(4)
        rows = sc.style_residual(df, "y", controls={c: F.col(c) for c in "sdb"}, rank="rank").collect()
        x = np.column_stack([np.ones(n), size, beta])
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        got = {r["ticker"]: r["residual"] for r in rows}
        assert [got[i] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-7)
        assert {r["rank"] for r in rows} == {2}


def test_winsor_zscores(spark):
    rng = np.random.default_rng(3)
    v = np.append(rng.normal(0, 1, 300), [50.0, -40.0])
    df = spark.createDataFrame([(D(2026, 8, 1), i, float(x), 1.0) for i, x in enumerate(v)], "as_of date, ticker int, v double, c double")
    got = {r["ticker"]: (r["v_z"], r["c_z"]) for r in sc.winsor_zscores(df, {"v": F.col("v"), "c": F.col("c")}).collect()}
    w = np.clip(v, *np.quantile(v, [0.01, 0.99]))
    assert [got[i][0] for i in range(len(v))] == pytest.approx(((w - w.mean()) / w.std(ddof=1)).tolist())
    assert {g[1] for g in got.values()} == {0.0}


def test_cohorts_and_costs(spark):
    m = spark.createDataFrame([("S", 1, "A", 2e8), ("S", 1, "B", 3e7), ("S", 2, "A", 2e8), ("S", 7, "B", 1.5e7)], "scheme string, capture_ord int, ticker string, adv_usd double")
    book = pf.cohort_weights(m, F.lit(8))
    got = {(r["book_ord"], r["ticker"]): r["weight"] for r in book.collect()}
    assert got[1, "A"] == 0.125 and got[2, "A"] == 0.375 and got[5, "A"] == 0.25 and (5, "B") not in got and got[8, "B"] == 0.25
    assert (9, "B") not in got
    t = {(r["book_ord"], r["ticker"]): round(r["change"], 9) for r in pf.trades(book, F.lit(8)).collect()}
    assert t == {(1, "A"): 0.125, (1, "B"): 0.125, (2, "A"): 0.25, (5, "A"): -0.125, (5, "B"): -0.125, (6, "A"): -0.25, (7, "B"): 0.25}
    c = {r["book_ord"]: r for r in pf.costs(pf.trades(book, F.lit(8))).collect()}
    assert c[1]["tiered_bps"] == pytest.approx(0.125 * 3 + 0.125 * 8) and c[7]["tiered_bps"] == pytest.approx(0.25 * 15)
    assert c[1]["flat_20_bps"] == pytest.approx(5.0) and c[1]["flat_0_bps"] == 0.0
    thin = spark.createDataFrame([("S", 1, "A", None, 0.5), ("S", 1, "B", 9e6, -0.5)], "scheme string, book_ord int, ticker string, adv_usd double, change double")
    assert pf.costs(thin).first()["tiered_bps"] == pytest.approx(15.0)
    assert spark.range(1).select(pf.tier_bps(F.lit(9e6))).first()[0] is None


def test_bh_fdr_keeps_one_lone_scheme(spark):
    low = spark.createDataFrame([("S1a", 0.001), ("S1b", 0.5), ("S1c", 0.6), ("S2", 0.7), ("S3", 0.8)], ["scheme", "p_value"])
    assert [r["scheme"] for r in inf.bh_fdr(low).where("keep").collect()] == ["S1a"]
    # schemes without a pick still count as tests
    assert inf.bh_fdr(spark.createDataFrame([("S1a", 0.05)], ["scheme", "p_value"])).where("keep").isEmpty()


def test_bh_fdr(spark):
    p = spark.createDataFrame([("a", 0.001), ("b", 0.039), ("c", 0.041), ("d", 0.09), ("e", 0.5)], "scheme string, p_value double")
    keep = {r["scheme"]: r["keep"] for r in inf.bh_fdr(p).collect()}
    assert keep == {"a": True, "b": True, "c": True, "d": False, "e": False}  # b fails its own bar and is carried by c
    assert not any(r["keep"] for r in inf.bh_fdr(p.withColumn("p_value", F.lit(0.9))).collect())


def test_bootstrap_and_null_are_stable_and_sensible(spark):
    rng = random.Random(1)
    mem = spark.createDataFrame([("S", D(2026, 1, 1) + dt.timedelta(days=7 * o), o, f"t{i}", 0.01 + rng.gauss(0, 0.001)) for o in range(1, 41) for i in range(5)],
                                "scheme string, as_of date, capture_ord int, ticker string, r double")
    a, b = (inf.block_bootstrap_ci(inf.block_sums(x, "r")).first() for x in (mem, mem.repartition(7)))
    assert a["n_blocks"] == 10 and a["ci_low"] < a["mean"] < a["ci_high"] and a["excludes_zero"]
    assert (a["ci_low"], a["ci_high"]) == pytest.approx((b["ci_low"], b["ci_high"]), abs=1e-12)
    uni = [(D(2026, 1, 1), f"t{i}", rng.random(), float(i % 10)) for i in range(500)]
    udf = spark.createDataFrame(uni, "as_of date, ticker string, drift double, v double")
    best = udf.where("v = 9").select(F.lit("best").alias("scheme"), "as_of", "ticker")
    some = udf.where("drift < 0.5").select(F.lit("half").alias("scheme"), "as_of", "ticker")
    got = {r["scheme"]: r for r in inf.random_entry_null(udf, best.unionByName(some), "drift", "v").collect()}
    assert got["best"]["p_value"] == pytest.approx(1 / 100) and got["half"]["p_value"] > 0.05
    assert got["best"]["null_mean"] == pytest.approx(4.5, abs=0.5)


def test_clock_start_and_regrade(spark):
    mem = spark.createDataFrame([("S1", D(2026, 1, 1)), ("S9", D(2026, 1, 1)), ("S9", D(2026, 6, 1))], "scheme string, as_of date")
    reg = spark.createDataFrame([("S1", D(2025, 1, 1)), ("S9", D(2026, 3, 1))], "scheme string, registered_on date")
    assert {tuple(r) for r in sc.after_registration(mem, reg).collect()} == {("S1", D(2026, 1, 1)), ("S9", D(2026, 6, 1))}
    ser = spark.createDataFrame([("S", D(2026, m, 1), float(m)) for m in range(1, 7)], "scheme string, as_of date, r double")
    cut = spark.createDataFrame([(D(2026, 3, 1),), (D(2026, 5, 15),), (D(2020, 1, 1),)], "cutoff date")
    assert {(r["cutoff"], r["captures"], r["mean"]) for r in inf.regrade(ser, cut).collect()} == {(D(2026, 3, 1), 3, 2.0), (D(2026, 5, 15), 5, 3.0)}


def test_target_raise_options(spark):
    df = spark.createDataFrame([("a", 0.1, False), ("b", 2.0, False), ("c", 3.0, True), ("d", -1.0, True), ("e", None, True)], "t string, target_pct double, confirmed boolean")
    names = lambda **k: [r["t"] for r in sc.target_raise(df, **k).collect()]
    assert names() == ["a", "b", "c"] and names(floor_pct=0.25) == ["b", "c"] and names(date_guard=True) == ["c"]
