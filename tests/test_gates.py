"""Integrity checks, leak guards, coverage and the frozen store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelflow.operators import guards as gd
from panelflow.operators import quality as ql
from panelflow.schema import CORE_FIELDS
from panelflow.sources import store

D = dt.date
HEAD = "capture_ord int, as_of date, n_raw long, n_rows long, mapped_fields array<string>, unmapped_columns array<string>, sha256 array<string>, copies int"


def checks(spark, second, today="2026-09-01", members=None, force=False):
    first = (1, D(2026, 8, 1), 100, 100, CORE_FIELDS, ["Volume"], ["aa"], 1)
    members = members or [(1, f"T{i}") for i in range(100)] + [(2, f"T{i}") for i in range(95)]
    df = ql.capture_checks(spark.createDataFrame([first, second], HEAD), spark.createDataFrame(members, "capture_ord int, ticker string"), today, force)
    return {r["check"]: (r["ok"], r["detail"]) for r in df.where(F.col("as_of") == F.lit(second[1])).collect()}, df


def test_clean_capture_passes(spark):
    got, df = checks(spark, (2, D(2026, 8, 8), 104, 103, CORE_FIELDS, ["Volume", "Extra"], ["bb"], 1))
    assert all(ok for ok, _ in got.values()) and got["unmapped columns"][1] == "Extra"
    assert "prior capture" not in got
    first = {r["check"] for r in df.where("as_of = DATE '2026-08-01'").collect()}
    assert "prior capture" in first and "row count vs prior" not in first
    ql.gate(df)


@pytest.mark.parametrize("second,failed", [
    ((2, D(2026, 8, 8), 106, 103, CORE_FIELDS, [], ["bb"], 1), "row count vs prior"),
    ((2, D(2026, 8, 8), 100, 100, CORE_FIELDS[1:], [], ["bb"], 1), "no column regression"),
    ((2, D(2026, 8, 8), 100, 100, CORE_FIELDS, [], ["x", "aa"], 1), "export is fresh"),
    ((2, D(2026, 9, 8), 100, 100, CORE_FIELDS, [], ["bb"], 1), "as-of not in the future"),
    ((2, D(2026, 8, 1), 100, 100, CORE_FIELDS, [], ["bb"], 1), "capture is after the prior one"),
    ((2, D(2026, 8, 8), 100, 100, CORE_FIELDS, [], ["bb"], 2), "not already captured"),
    ((2, D(2026, 8, 8), 0, 0, CORE_FIELDS, [], ["bb"], 1), "file readable"),
])
def test_each_failure_is_caught(spark, second, failed):
    got, df = checks(spark, second)
    assert not got[failed][0]
    with pytest.raises(ValueError, match=failed.split()[0]):
        ql.gate(df)


def test_overlap_and_empty_prior(spark):
    got, _ = checks(spark, (2, D(2026, 8, 8), 100, 100, CORE_FIELDS, [], ["bb"], 1), members=[(1, f"T{i}") for i in range(100)] + [(2, f"T{i}") for i in range(89)])
    assert got["key overlap vs prior"] == (False, "89.0")
    heads = [(1, D(2026, 8, 1), 0, 0, CORE_FIELDS, [], ["aa"], 1), (2, D(2026, 8, 8), 5, 5, CORE_FIELDS, [], ["bb"], 1)]
    df = ql.capture_checks(spark.createDataFrame(heads, HEAD), spark.createDataFrame([(2, "A")], "capture_ord int, ticker string"), "2026-09-01")
    got = {r["check"]: r["ok"] for r in df.where("as_of = DATE '2026-08-08'").collect()}
    assert got["row count vs prior"] is False and got["key overlap vs prior"] is False


def test_prior_capture_with_fallback(spark):
    rows = [("weekly", D(2026, 7, 31), ""), ("weekly", D(2026, 8, 2), ""), ("daily", D(2026, 8, 1), "0746"), ("daily", D(2026, 8, 1), "2200"), ("daily", D(2026, 8, 3), "")]
    df = spark.createDataFrame(rows, "stream string, as_of date, hhmm string")
    got = {(r["as_of"].day, r["hhmm"]): (r["prior_stream"], r["prior_as_of"], r["prior_hhmm"]) for r in ql.prior_captures(df, "daily", "weekly").collect()}
    assert got == {(1, "0746"): ("weekly", D(2026, 7, 31), ""), (1, "2200"): ("daily", D(2026, 8, 1), "0746"), (3, ""): ("daily", D(2026, 8, 1), "2200")}
    alone = ql.prior_captures(df, "weekly").collect()
    assert [r["prior_as_of"] for r in sorted(alone, key=lambda r: r["as_of"])] == [None, D(2026, 7, 31)]


def test_last_completed_session(spark):
    cal = spark.createDataFrame([(D(2026, 8, 6), dt.datetime(2026, 8, 6, 20)), (D(2026, 8, 7), dt.datetime(2026, 8, 7, 20))], "session date, close_ts timestamp_ntz")
    at = lambda now: spark.range(1).select(ql.last_completed_session(cal, now)).first()[0]
    assert at("2026-08-07 19:59:00") == D(2026, 8, 6) and at("2026-08-07 20:00:00") == D(2026, 8, 7)


def test_coverage_and_slots(spark):
    caps = spark.createDataFrame([(D(2026, 8, 4), "0746"), (D(2026, 8, 7), "2200"), (D(2026, 8, 8), "")], "as_of date, hhmm string")
    sessions = spark.createDataFrame([(D(2026, 8, d),) for d in (3, 4, 5, 6, 7)], "session date")
    cov = ql.session_coverage(caps, sessions)
    assert {r["session"].day for r in cov.where("covered").collect()} == {3, 6, 7}
    assert tuple(ql.coverage_summary(cov).first()) == (3, 5, 0.6, D(2026, 8, 7))
    assert tuple(ql.slot_split(caps).first()) == (1, 1, 1)


def test_leak_scan_equals_substring_search(spark):
    docs = ['{"a":"NVDA","b":["x","AAPL"]}', 'NVDA unquoted', '"AA"PL"', '""', 'no', '"NVDA" twice "NVDA"']
    keys = ["NVDA", "AAPL", "PL", "AA", ",", "MISS", ""]
    got = {r["key"]: r["n_rows"] for r in gd.leaked_keys(
        spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(list(enumerate(docs)), "id int, t string"), "t", "id").collect()}
    want = {k: n for k in keys if (n := sum(f'"{k}"' in d for d in docs))}
    assert got == want
    leaks = spark.createDataFrame([("NVDA", 1)], "key string, n_rows long")
    with pytest.raises(ValueError, match="NVDA"):
        gd.refuse_leaks(leaks, [])


def test_banned_fields_at_any_depth(spark):
    df = spark.sql("SELECT 1 AS ok, array(struct(1 AS ticker, struct(2 AS best_analyst_price_target_x) AS d)) AS m, map('a', struct(1 AS company)) AS q")
    assert gd.banned_names(df) == ["best_analyst_price_target_x", "company", "ticker"]
    assert gd.banned_names(spark.sql("SELECT 1 AS upgrades, 2 AS ticker_count")) == []


def test_store_freezes_captures(spark, tmp_path):
    path = str(tmp_path / "snap")
    rec = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ticker string, price double")
    store.write_snapshot(rec, path, "weekly", "2026-08-01")
    store.write_snapshot(rec, path, "daily", "2026-08-01", "0746")
    store.write_snapshot(rec, path, "daily", "2026-08-01", "2200")
    with pytest.raises(FileExistsError):
        store.write_snapshot(rec, path, "weekly", "2026-08-01")
    store.write_snapshot(rec.limit(1), path, "weekly", "2026-08-01", force=True)
    assert store.load_snapshot(spark, path, "weekly", "2026-08-01").count() == 1
    assert sorted({r["hhmm"] for r in store.load_stream(spark, path, "daily").collect()}) == ["0746", "2200"]
    with pytest.raises(FileNotFoundError):
        store.load_snapshot(spark, path, "weekly", "2026-08-02")
    panel = rec.withColumn("as_of", F.to_date(F.lit("2026-08-01")))
    store.write_panel(panel, str(tmp_path / "panel"))
    with pytest.raises(FileExistsError):
        store.write_panel(panel, str(tmp_path / "panel"))
    charts = str(tmp_path / "charts")
    store.write_charts(spark.createDataFrame([("OLD", 1.0)], "symbol string, close double"), charts)
    store.write_charts(spark.createDataFrame([("NEW", 1.0)], "symbol string, close double"), charts)
    assert [r["symbol"] for r in spark.read.parquet(charts).collect()] == ["NEW"]
    store.write_document({"kpis": rec}, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).count() == 2


def test_tolerant_scan_skips_corrupt_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"as_of": "2026-08-01"}')
    (tmp_path / "b.json").write_text('{"as_of": ')
    got = store.read_json_captures(spark, str(tmp_path), "as_of string")
    assert [r["as_of"] for r in got.collect()] == ["2026-08-01"]


def test_two_captures_of_one_day_are_ordered_by_time(spark):
    from pyspark.sql import Row

    def head(n, hhmm):
        return Row(capture_ord=n, as_of=__import__("datetime").date(2026, 7, 1), hhmm=hhmm, n_raw=1, n_rows=1, mapped_fields=["ticker"], unmapped_columns=["x"], sha256=[f"s{n}"], copies=1)

    members = spark.createDataFrame([(1, "A"), (2, "A")], "capture_ord int, ticker string")
    for second, ok in (("2200", True), ("0700", False)):
        df = ql.capture_checks(spark.createDataFrame([head(1, "0746"), head(2, second)]), members, "2026-09-01")
        found = {r["ok"] for r in df.where("check = 'capture is after the prior one'").collect()}
        assert found == {ok}


def test_a_store_of_timed_captures_only_is_read(spark, tmp_path):
    path = str(tmp_path / "timed")
    store.write_snapshot(spark.createDataFrame([("A",)], "ticker string"), path, "daily", "2026-07-01", "0746")
    assert [r["hhmm"] for r in store.load_stream(spark, path, "daily").collect()] == ["0746"]


def test_spreadsheets_are_refused_and_quoted_line_breaks_kept(spark, tmp_path):
    from panelflow.sources import exports

    (tmp_path / "a.csv").write_text('Ticker,Name\nA,"two\nlines"\n')
    assert [r["Name"] for r in exports.read_pages(spark, [str(tmp_path)]).collect()] == ["two\nlines"]
    (tmp_path / "b.xlsx").write_bytes(b"x")
    with pytest.raises(ValueError, match="b.xlsx"):
        exports.page_files(spark, [str(tmp_path)])
