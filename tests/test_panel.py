"""Revision, cross-section and universe rules on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions import signals as sg
from panelflow.operators import crosssection as cs
from panelflow.operators import revision as rv
from panelflow.operators import universe as un

D = dt.date
CAPS = [D(2026, 7, 31), D(2026, 8, 7), D(2026, 8, 14)]
FIELDS = ("as_of date, capture_ord int, prev_as_of date, next_as_of date, ticker string, sector string, analyst_consensus string, "
          "best_analyst_price_target double, analyst_price_target double, rating_date date, smart_score double, insider_signal string, "
          "news_sentiment string, liquid boolean, matched boolean")


def panel(spark, *records):
    out = []
    for r in records:
        o = r["ord"]
        out.append((CAPS[o], o + 1, CAPS[o - 1] if o else None, CAPS[o + 1] if o < 2 else None, r["t"], r.get("sector", "Tech"), r.get("cons", "Hold"),
                    r.get("bt", 100.0), r.get("ct", 100.0), r.get("rd"), r.get("ss", 5.0), r.get("ins"), r.get("news"), r.get("liquid", True), r.get("matched", True)))
    return spark.createDataFrame(out, FIELDS)


def test_direction_confirmation_and_scores(spark):
    p = panel(
        spark,
        dict(ord=0, t="UP", cons="Hold"), dict(ord=1, t="UP", cons="Strong Buy", rd=CAPS[0], bt=100.5),  # boundary day is inside
        dict(ord=0, t="DN", cons="Hold"), dict(ord=1, t="DN", cons="Strong Sell", rd=D(2026, 7, 30), bt=94.0, ss=4.0),
        dict(ord=0, t="CT"), dict(ord=1, t="CT", ct=120.0),  # a consensus-target move alone shows no row
        dict(ord=0, t="FL", ins=None), dict(ord=1, t="FL", ins="Positive"),
        dict(ord=0, t="BL", ins=""), dict(ord=1, t="BL", ins=None),  # blank to null is no flip
        dict(ord=0, t="ODD", cons="Great"), dict(ord=1, t="ODD", cons="Hold"),
        dict(ord=0, t="ZERO", bt=0.0), dict(ord=1, t="ZERO", bt=5.0),
    )
    got = {r["ticker"]: r for r in rv.revision_rows(p).collect()}
    assert set(got) == {"UP", "DN", "FL"}
    assert (got["UP"]["rev_rank"], got["UP"]["confirmed"], got["UP"]["rev_badge"]) == (7, True, "up")
    assert got["UP"]["rev_note"] == "Hold → Strong Buy (confirmed in window) · best target +0.5%"
    assert (got["DN"]["rev_rank"], got["DN"]["confirmed"]) == (-3 - 4 - 1, False)
    assert got["DN"]["rev_note"].endswith("best target -6.0% · Smart Score -1")
    assert got["FL"]["rev_rank"] == 0 and got["FL"]["rev_badge"] is None and got["FL"]["rev_note"] == "insider — → Positive"
    assert [r["ticker"] for r in rv.panel_order(rv.revision_rows(p)).collect()] == ["UP", "FL", "DN"]


def test_gaps_are_not_adjacent_and_churn_reasons(spark):
    p = panel(
        spark,
        dict(ord=0, t="GAP", bt=100.0), dict(ord=2, t="GAP", bt=150.0),  # missing in between: no pair
        dict(ord=0, t="OUT"), dict(ord=1, t="OUT", liquid=False), dict(ord=2, t="OUT"),
        dict(ord=0, t="UNM"), dict(ord=1, t="UNM", liquid=False, matched=False),
        dict(ord=1, t="NEW"), dict(ord=2, t="NEW"),
    )
    reasons = {(r["as_of"], r["ticker"]): r["reason"] for r in rv.left_names(p).collect()}
    assert reasons == {
        (CAPS[1], "GAP"): "absent from this week's export",
        (CAPS[1], "OUT"): "lost index membership or liquidity floor",
        (CAPS[1], "UNM"): "unmatched on the feed",
    }
    assert {tuple(r) for r in rv.entered(p).collect()} == {(CAPS[1], "NEW"), (CAPS[2], "GAP"), (CAPS[2], "OUT")}
    counts = {r["as_of"]: r for r in rv.pair_counts(p).collect()}
    assert (counts[CAPS[1]]["pairs"], counts[CAPS[1]]["entered_n"], counts[CAPS[1]]["left_n"]) == (0, 1, 3)
    assert (counts[CAPS[2]]["pairs"], counts[CAPS[2]]["entered_n"], counts[CAPS[2]]["left_n"]) == (1, 2, 0)
    assert counts[CAPS[1]]["window_days"] == 7


def test_breadth_forms_differ(spark):
    p = panel(spark, dict(ord=0, t="A", sector="Quiet"), dict(ord=1, t="A", sector="Quiet"),
              dict(ord=0, t="B", sector=None), dict(ord=1, t="B", sector=None, bt=110.0))
    assert {r["sector"] for r in rv.breadth_public(p).collect()} == {"Quiet", "—"}
    assert {(r["sector"], r["n"], r["raises"]) for r in rv.breadth_view(p).collect()} == {("—", 1, 1)}


def test_partition_and_order_invariance(spark):
    recs = [dict(ord=o, t=f"t{i}", cons=["Hold", "Strong Buy", "Moderate Sell"][(i + o) % 3], bt=100.0 + (i * o) % 7, ss=float(1 + (i + o) % 10), rd=CAPS[o]) for o in range(3) for i in range(40)]
    a, b = panel(spark, *recs).repartition(1), panel(spark, *reversed(recs)).repartition(9)
    assert rv.pair_counts(a).exceptAll(rv.pair_counts(b)).isEmpty()
    assert rv.revision_rows(a).exceptAll(rv.revision_rows(b)).isEmpty()


def test_percent_buy_counts_unlabelled_rows(spark):
    p = panel(spark, dict(ord=0, t="A", cons="Strong Buy"), dict(ord=0, t="B", cons=None), dict(ord=0, t="C", cons="Hold"), dict(ord=0, t="D", cons="Odd"))
    assert cs.sector_summary(p).first()["pct_buy"] == 25.0
    mix = {r["label"]: r["n"] for r in cs.consensus_mix(p).collect()}
    assert mix == {"Strong Buy": 1, "Moderate Buy": 0, "Hold": 1, "Moderate Sell": 0, "Strong Sell": 0}


def test_histogram_half_even(spark):
    p = panel(spark, *[dict(ord=0, t=str(i), ss=s) for i, s in enumerate([2.5, 3.5, 0.4, 10.6, None, 1.0])])
    h = {r["bucket"]: r["n"] for r in cs.score_histogram(p).collect()}
    assert h[2] == 1 and h[4] == 1 and h[1] == 1 and sum(h.values()) == 3 and len(h) == 10


def test_stance_and_latest(spark):
    df = spark.createDataFrame([("Very Bullish",), ("Very Negative",), ("Neutral",), (None,)], "s string")
    assert [r[0] for r in df.select(sg.stance(F.col("s"))).collect()] == ["positive", "negative", "neutral", "neutral"]
    p = panel(spark, dict(ord=0, t="A"), dict(ord=1, t="A"), dict(ord=2, t="B"))
    assert [r["ticker"] for r in cs.nth_latest(p, 1).collect()] == ["B"]
    assert [r["capture_ord"] for r in cs.nth_latest(p, 2).collect()] == [2]


def test_display_orders(spark):
    d1, d2 = D(2026, 8, 1), D(2026, 8, 8)
    b = spark.createDataFrame([(d1, "A", 1), (d1, "C", 3), (d1, "B", 3), (d2, "A", -1), (d1, "D", -2)], "as_of date, sector string, net_upgrades int").repartition(3)
    assert [(r[0].day, r[1]) for r in rv.breadth_order(b).collect()] == [(1, "B"), (1, "C"), (1, "A"), (1, "D"), (8, "A")]
    n = spark.createDataFrame([(d2, "A"), (d1, "B"), (d1, "A")], "as_of date, ticker string").repartition(3)
    assert [(r[0].day, r[1]) for r in rv.churn_order(n).collect()] == [(1, "A"), (1, "B"), (8, "A")]
    s = spark.createDataFrame([(d1, "A", 1), (d1, "C", 5), (d1, "B", 5)], "as_of date, sector string, n int").repartition(3)
    assert [r[1] for r in cs.sector_order(s).collect()] == ["B", "C", "A"]


def bars(spark, symbol, closes, start=D(2026, 1, 1), volume=1e6):
    return [(symbol, start + dt.timedelta(days=i), c, c, volume) for i, c in enumerate(closes)]


BAR = "symbol string, session date, close double, close_capital double, volume double"


def test_symbol_spellings_and_misses(spark):
    b = spark.createDataFrame(bars(spark, "BRK-B", [1.0]) + bars(spark, "BF B", [1.0]) + bars(spark, "A.B", [1.0]) + bars(spark, "A-B", [1.0]), BAR)
    t = spark.createDataFrame([("brk.b",), ("BF.B",), ("A/B",), ("a.b",), ("ZZZ",)], "ticker string")
    got = {r["ticker"]: r["feed_symbol"] for r in un.resolve_symbols(t, b).collect()}
    assert got == {"brk.b": "BRK-B", "BF.B": "BF B", "A/B": "A.B", "a.b": "A.B", "ZZZ": None}


def test_nan_close_is_not_liquid_and_misses_are_kept(spark):
    b = spark.createDataFrame(bars(spark, "OK", [10.0] * 30, volume=2e6) + bars(spark, "NAN", [10.0] * 29 + [float("nan")], volume=2e6), BAR)
    m = spark.createDataFrame([("OK", "S&P 500", D(2026, 1, 1), 1), ("NAN", "S&P 500", D(2026, 1, 1), 1), ("OK", "S&P MidCap 400", D(2026, 1, 5), 1), ("OK", "S&P MidCap 400", D(2026, 1, 20), 0)],
                              "symbol string, index_name string, session date, is_member int")
    s = spark.createDataFrame([("ok", D(2026, 1, 30)), ("ok", D(2026, 1, 10)), ("nan", D(2026, 1, 30)), ("zz", D(2026, 1, 30))], "ticker string, as_of date")
    got = {(r["ticker"], r["as_of"].day): r for r in un.merge_panel(s, b, m).collect()}
    assert len(got) == 4
    assert got["ok", 30]["liquid"] and got["ok", 30]["member_of"] == ["S&P 500"]
    assert got["ok", 10]["member_of"] == ["S&P 500", "S&P MidCap 400"] and got["ok", 10]["liquid"] and got["ok", 10]["adv_usd"] == 2e7
    assert got["nan", 30]["close_tr"] is None and got["nan", 30]["liquid"] is False
    assert got["zz", 30]["matched"] is False and got["zz", 30]["liquid"] is False and got["zz", 30]["member_of"] == []


def test_a_return_without_a_base_is_null_and_not_an_older_one(spark):
    closes = [10.0 + i for i in range(70)]
    closes[5] = 0.0  # the base of bar 68
    b = spark.createDataFrame(bars(spark, "OK", closes) + bars(spark, "LATE", [1.0] * 70), BAR)
    day = lambda i: D(2026, 1, 1) + dt.timedelta(days=i)
    a = spark.createDataFrame([("OK", day(i)) for i in (67, 68, 69)], "symbol string, as_of date")
    got = {r["as_of"]: r for r in un.liquidity_asof(a, b).collect()}
    assert got[day(68)]["tr_3m_pct"] is None and got[day(68)]["vol_ann_pct"] is not None
    assert got[day(67)]["tr_3m_pct"] == pytest.approx((77 / 14 - 1) * 100)
    assert got[day(69)]["tr_3m_pct"] == pytest.approx((79 / 16 - 1) * 100)


def test_bar_windows_brute_force(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    c = 100 * np.cumprod(1 + rng.normal(0, 0.02, 300))
    vol = rng.integers(1, 100, 300).astype(float)
    vol[[5, 50, 51, 120]] = np.nan
    days = [D(2025, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    df = spark.createDataFrame([("X", d, float(a), float(a), None if np.isnan(v) else float(v)) for d, a, v in zip(days, c, vol)], BAR)
    s = pd.Series(c)
    dv = (s * pd.Series(vol)).dropna()
    want = dv.rolling(21, min_periods=1).median()
    got = [r["adv_usd"] for r in un.dollar_volume(df).orderBy("session").collect()]
    assert got == pytest.approx(want.tolist())
    t = un.trend(df).orderBy("session").toPandas()
    assert t["tr_3m_pct"].isna().sum() == 63 and t["tr_3m_pct"].iloc[-1] == pytest.approx((s.iloc[-1] / s.iloc[-64] - 1) * 100)
    assert t["vol_ann_pct"].isna().sum() == 40
    assert t["vol_ann_pct"].iloc[-1] == pytest.approx(s.pct_change().tail(63).std(ddof=1) * 252**0.5 * 100)
    ch = un.chart_history(df, keep=262).orderBy("session").toPandas()
    assert len(ch) == 262 and ch["ma50"].isna().sum() == 11  # averages start on the 50th bar, the tail on the 39th
    assert ch["ma50"].iloc[11] == pytest.approx(s.iloc[:50].mean(), abs=0.006)
    assert ch["ma200"].iloc[-1] == pytest.approx(s.tail(200).mean(), abs=0.006)
    assert isinstance(un.chart_history(df).schema["ma50"].dataType, T.DoubleType)
