"""Text cells, dates, header mapping and export scanning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelflow.functions import cells, clock
from panelflow.functions import signals as sg
from panelflow.sources import exports as ex

D = dt.date

NUMBERS = [
    ("$1.35M", 1.35e6), ("615.53% Upside", 615.53), ("(0.64%)", -0.64), ("293.86% Downside", -293.86),
    ("$885.30M", 885.30e6), ("$4.94T", 4.94e12), ("$309.33 (51.54% Upside)", 309.33), ("-2.42%", -2.42),
    ("$4,939,703,881,836", 4939703881836.0), ("-1.45%", -1.45), ("n/a", None),
    # traps: the suffix is any first letter after the number, a leading point is ignored
    ("12 bps", 12e9), ("5 Moderate", 5e6), (".5", 5.0), ("$-3", 3.0), ("\t7  ", 7.0), ("--", None), ("NaN", None), ("abc", None), (None, None),
    ("12 x 5M", 12.0),
]


def test_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", cells.numeric_cell(F.col("t")).alias("n")).collect()}
    for i, (text, want) in enumerate(NUMBERS):
        assert got[i] == pytest.approx(want) if want is not None else got[i] is None, text


def test_rating_dates_two_parsers_disagree(spark):
    cases = [
        ("Jul 08, 2026", D(2026, 7, 8), D(2026, 7, 8)), ("July 8, 2026", D(2026, 7, 8), None), ("2026-07-08", D(2026, 7, 8), None),
        ("May 27, 2026", D(2026, 5, 27), D(2026, 5, 27)), ("rated Jul 8, 2026", None, D(2026, 7, 8)),
        ("Feb 29, 2023", None, None), ("Feb 29, 2024", D(2024, 2, 29), D(2024, 2, 29)), ("", None, None), (None, None, None), ("Abc 08, 2026", None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    for r in df.select("i", cells.rating_date_lenient(F.col("t")).alias("a"), cells.rating_date_strict(F.col("t")).alias("b")).collect():
        assert (r["a"], r["b"]) == cases[r["i"]][1:], cases[r["i"]]


def test_capture_key(spark):
    names = ["x/snapshot_2026-08-01.json", "snapshot_2026-08-01_0746.json", "snapshot_latest.json", "other.json"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    a, h = cells.capture_key(F.col("n"))
    got = {r["i"]: (r["a"], r["h"]) for r in df.select("i", a.alias("a"), h.alias("h")).collect()}
    assert got[0] == (D(2026, 8, 1), "") and got[1] == (D(2026, 8, 1), "0746")
    assert got[2][0] is None and got[3][0] is None


def test_clocks(spark):
    df = spark.createDataFrame([(D(2026, 8, 5), "0746"), (D(2026, 1, 5), "")], "d date, h string")
    et = [str(r[0]) for r in df.orderBy("d").select(clock.singapore_to_eastern(clock.stamp_instant(F.col("d"), F.col("h")))).collect()]
    assert et == ["2026-01-04 11:00:00", "2026-08-04 19:46:00"]


def test_window_kind(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    cases = [
        ("2026-08-04 19:46:00", "2026-08-05 09:54:00", "overnight"), ("2026-08-04 09:30:00", "2026-08-04 16:00:00", "intra-session"),
        ("2026-08-04 10:00:00", "2026-08-04 16:00:01", "session+close"), ("2026-08-04 04:00:00", "2026-08-04 12:00:00", "pre-open"),
    ]
    df = spark.createDataFrame([(i, t(a), t(b)) for i, (a, b, _) in enumerate(cases)], "i int, a timestamp_ntz, b timestamp_ntz")
    for r in df.select("i", clock.window_kind(F.col("a"), F.col("b")).alias("k")).collect():
        assert r["k"] == cases[r["i"]][2]


def test_horizons_and_unknown_name(spark):
    cases = [(D(2026, 1, 31), "1m", D(2026, 2, 28)), (D(2028, 1, 31), "1m", D(2028, 2, 29)), (D(2025, 12, 31), "1m", D(2026, 1, 31)),
             (D(2025, 11, 30), "3m", D(2026, 2, 28)), (D(2025, 12, 31), "1w", D(2026, 1, 7))]
    df = spark.createDataFrame(cases, "d date, h string, w date")
    assert df.where(clock.horizon_end_by_name(F.col("d"), F.col("h")) != F.col("w")).isEmpty()
    with pytest.raises(KeyError):
        clock.horizon_end(F.col("d"), "2y")


def test_business_days_back_matches_pandas(spark):
    import pandas as pd

    days = pd.date_range("2025-12-20", periods=40)
    for n in (1, 3, 7):
        df = spark.createDataFrame([(d.date(), (d - pd.tseries.offsets.BDay(n)).date()) for d in days], "d date, w date")
        assert df.where(clock.business_days_back(F.col("d"), n) != F.col("w")).isEmpty()


def test_header_mapping():
    headers = ["Ticker", "Name", "Price", "Change %", "Analyst Price Target %", "Analyst Price Target", "Analyst Consensus", "Smart Score",
               "Market Cap", "Dividend Yield %", "P/E Ratio", "Best Price Target Upside", "Top Analysts' Price Target - upside/downside",
               "Best Analyst Consensus", "Last Rating Date", "Volume"]
    mapping, unmapped = ex.map_headers(headers)
    assert unmapped == ["Volume"]
    assert mapping["Analyst Price Target %"] == "analyst_price_target_upside_pct"
    assert mapping["Analyst Price Target"] == "analyst_price_target"
    assert mapping["Price"] == "price" and mapping["Name"] == "company"
    assert mapping["Best Price Target Upside"] == "best_analyst_price_target"
    assert mapping["Best Analyst Consensus"] == "best_analyst_consensus"


def test_csv_pages_to_snapshot(spark, tmp_path):
    (tmp_path / "p1.csv").write_text(
        "﻿Ticker,Name,Price,Last Rating Date,Volume\n nvda ,Nvidia,$201.16,\"Jul 08, 2026\",1\n,,,,\nnan,x,$1,,\nNA,Nano,$2,,\n", encoding="utf-8")
    (tmp_path / "p2.csv").write_text("Ticker,Name,Price\nNVDA,Second,$9\naapl,Apple,(3.5%)\n", encoding="utf-8")
    raw = ex.read_pages(spark, [str(tmp_path), str(tmp_path / "p1.csv")])
    assert raw.count() == 5  # blank row dropped, repeated path dropped
    snap = ex.snapshot(raw, "2026-07-10")
    early = ex.keep_first(ex.normalise(raw, "2026-07-10"))
    assert early.select("ticker", "company", "price", "n_dropped").exceptAll(snap.select("ticker", "company", "price", "n_dropped")).isEmpty()
    got = {r["ticker"]: (r["company"], r["price"], r["n_dropped"]) for r in snap.collect()}
    assert got == {"NVDA": ("Nvidia", 201.16, 1), "AAPL": ("Apple", -3.5, 0), "NA": ("Nano", 2.0, 0)}
    assert "NA" not in {r["ticker"] for r in ex.normalise(ex.read_pages(spark, [str(tmp_path)], na_tokens=["NA"]), "2026-07-10").collect()}
    prints = {r["file"]: r["sha256"] for r in ex.fingerprints(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "p2.csv")]).collect()}
    import hashlib

    assert prints["p2.csv"] == hashlib.sha256((tmp_path / "p2.csv").read_bytes()).hexdigest()
    assert ex.newest_file(spark, str(tmp_path)).first()["path"].endswith(".csv")
    with pytest.raises(FileNotFoundError):
        ex.page_files(spark, [])
    with pytest.raises(ValueError):
        ex.normalise(raw.drop("Ticker"), "2026-07-10")


def test_calendar_and_header_row(spark):
    assert spark.range(1).where(F.try_to_date(F.lit("2023-02-29"), "yyyy-MM-dd").isNotNull()).isEmpty()
    df = spark.createDataFrame([(D(2026, 8, 1), "A", 0), (D(2026, 8, 1), "B", 2)], "as_of date, ticker string, n_dropped int")
    h = ex.capture_header(df, {"Ticker": "ticker"}, ["Volume"]).first()
    assert (h["as_of_weekday"], h["as_of_is_weekend"], h["n_rows"], h["n_dropped"], h["unmapped_columns"]) == ("Saturday", True, 2, 2, ["Volume"])


def test_two_sided_p_against_erfc(spark):
    import math

    df = spark.createDataFrame([(z,) for z in (-3.8, -0.63, 0.0, 1.59, 2.54)], "z double")
    for r in df.select("z", sg.two_sided_normal_p(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / 2**0.5), abs=2e-7)


def test_score_rounding_half_even_and_target_floor(spark):
    df = spark.createDataFrame([(2.5, 100.0, 100.26), (3.5, 100.0, 100.24), (None, 0.0, 5.0)], "s double, a double, b double")
    got = df.select(F.bround("s", 0), sg.target_move(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.26), (4.0, None), (None, None)]
