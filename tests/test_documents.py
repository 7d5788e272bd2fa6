"""Public and private documents: nested walk of the guards, refusals, files read back."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from panelflow.operators import crosssection as cs
from panelflow.operators import documents as dc
from panelflow.operators import guards as gd
from panelflow.operators import revision as rv
from panelflow.plans import weekly
from panelflow.sources import driver_tables as dtab
from panelflow.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    return dtab.document_panel(spark, SF).cache()


def nested(spark):
    return spark.createDataFrame(
        [(1, (["AAA", None], {"BBB": [("x", 1.5)]}), None, dt.date(2026, 1, 2), True)],
        "id int, s struct<l array<string>, m map<string, array<struct<t string, v double>>>>, e map<string, string>, d date, b boolean",
    )


def test_leaves_reach_every_level(spark):
    got = {(r.path, r.role, r.text, r.number) for r in gd.leaves(nested(spark)).collect()}
    assert got == {
        ("id", "value", None, 1.0), ("s.l[0]", "value", "AAA", None), ("s.l[1]", "value", None, None), ("s.m", "key", "BBB", None),
        ("s.m.BBB[0].t", "value", "x", None), ("s.m.BBB[0].v", "value", None, 1.5), ("d", "value", "2026-01-02", None), ("b", "value", "true", None),
    }


@pytest.mark.parametrize("key,path", [("AAA", "s.l[0]"), ("BBB", "s.m"), ("x", "s.m.BBB[0].t")])
def test_a_key_is_found_at_any_depth(spark, key, path):
    keys = spark.createDataFrame([(key,), ("",), (None,)], "key string")
    (hit,) = gd.leaked_leaves(keys, gd.leaves(nested(spark))).collect()
    assert (hit.path, hit.key, hit.n) == (path, key, 1)
    with pytest.raises(ValueError, match=key):
        gd.refuse_document(keys, nested(spark))


def test_part_of_a_text_is_no_key(spark):
    keys = spark.createDataFrame([("AA",), ("A",)], "key string")
    gd.refuse_document(keys, nested(spark))


@pytest.mark.parametrize("name", ["ticker", "rows", "x_last_rating_date_y"])
def test_banned_map_keys_are_refused(spark, name):
    doc = spark.range(1).select(F.struct(F.create_map(F.lit(name), F.lit(1)).alias("m")).alias("s"))
    assert gd.banned_names(doc) == []
    with pytest.raises(ValueError, match=name):
        gd.refuse_document(spark.createDataFrame([], "key string"), doc)


def test_public_file_is_one_nested_row_without_names(spark, panel, tmp_path):
    weekly.publish_document(panel, f"{tmp_path}/pub", "2001-01-15")
    (line,) = [r.value for r in spark.read.text(f"{tmp_path}/pub").collect()]
    doc = json.loads(line)
    assert set(doc["smart_score_hist"]) == {str(b) for b in range(1, 11)}
    assert list(doc["consensus"]) == ["Strong Buy", "Moderate Buy", "Hold", "Moderate Sell", "Strong Sell"]
    assert not {f'"{r.ticker}"' for r in panel.select("ticker").distinct().collect()} & set(re.findall(r'"[^"]*"', line))
    assert [s["n"] for s in doc["by_sector"]] == sorted((s["n"] for s in doc["by_sector"]), reverse=True)
    assert doc["revision"]["available"] and doc["weekly"][-1]["as_of"] == doc["as_of"]
    assert len(doc["weekly"]) == doc["accrual"]["snapshots"] and set(doc["sentiment"]) == {"insider", "hedgefund", "investor"}
    assert sum(doc["consensus"].values()) <= doc["universe"]["liquid"] == doc["kpis"]["liquid"]


def test_first_capture_has_no_window(spark, panel):
    first = panel.where("prev_as_of IS NULL").withColumn("next_as_of", F.lit(None).cast("date"))
    doc = dc.public_document(first, "2001-01-15").first()
    assert not doc.revision.available and doc.revision.pairs is None and len(doc.weekly) == 1


def test_nothing_is_written_on_a_leak(spark, panel, tmp_path):
    leaky = panel.withColumn("ticker", F.when(F.col("ticker").endswith("7"), F.col("sector")).otherwise(F.col("ticker")))
    with pytest.raises(ValueError, match="publication refused"):
        weekly.publish_document(leaky, f"{tmp_path}/pub", "2001-01-15")
    assert not (tmp_path / "pub").exists()


def test_private_rows_have_their_24_fields_and_come_back(spark, panel, tmp_path):
    charted = panel.select("ticker").where("ticker LIKE '%2'")
    table, revision = weekly.keep_private(panel, charted, f"{tmp_path}/priv")
    assert set(table.columns) == {"as_of", "chart", *dc.ROW_FIELDS} and len(table.columns) == 25
    want = dc.private_rows(panel, charted)
    assert table.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(table.select(want.columns)).isEmpty()
    assert table.count() == panel.where("liquid").count()  # repeated names in `charted` add no rows
    flags = {r.ticker for r in charted.collect()}
    assert all(r.chart == (r.ticker in flags) for r in revision.select("ticker", "chart").distinct().collect())


def named_rows(spark, n):
    """Rows of `n` names at two captures, with a field that is null for some and a text that needs escapes."""
    return spark.range(n).select(
        F.explode(F.array(*[F.lit(d).cast("date") for d in ("2026-01-02", "2026-01-09")])).alias("as_of"),
        F.concat(F.lit("N"), "id").alias("ticker"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("upside"),
        F.concat(F.lit('a "quoted"\nname '), "id").alias("company"))


def test_rows_by_capture_are_kept_compressed_and_whole(spark, tmp_path):
    rows = named_rows(spark, 2000)
    store.write_rows_by_capture(rows, f"{tmp_path}/kept")
    read = lambda: store.read_nested(spark, f"{tmp_path}/kept", rows.schema).select(rows.columns)
    assert read().count() == 4000 and read().exceptAll(rows).isEmpty()
    files = [f for f in (tmp_path / "kept").rglob("part-*") if f.is_file()]
    assert {f.parent.name for f in files} == {"as_of=2026-01-02", "as_of=2026-01-09"}
    plain = rows.select(F.sum(F.length(F.to_json(F.struct("ticker", "upside", "company"), {"ignoreNullFields": "false"})) + 1)).first()[0]
    assert sum(f.stat().st_size for f in files) < plain / 3
    # a second capture's rows leave the first's alone
    store.write_rows_by_capture(rows.where("as_of = '2026-01-09' AND ticker = 'N5'"), f"{tmp_path}/kept")
    assert {str(r.as_of): r["count"] for r in read().groupBy("as_of").count().collect()} == {"2026-01-02": 2000, "2026-01-09": 1}


def test_chart_flags_are_dealt_out_by_name(spark):
    """Names grow with the panel: no task and no driver may hold all of them, nor is a wide row sorted by its name."""
    rows, charted = named_rows(spark, 50), spark.createDataFrame([("N1",), ("N1",), (None,), ("N7",), ("elsewhere",)], "ticker string")
    flagged = dc.with_charts(rows, charted)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.ticker, r.chart) for r in flagged.where("chart").collect()) == [("N1", True)] * 2 + [("N7", True)] * 2
    assert flagged.count() == 100 and flagged.where("chart IS NULL").isEmpty()


DAYS = [dt.date(2026, 1, 2), dt.date(2026, 1, 9), dt.date(2026, 1, 16)]


def moving(spark, *rows):
    """Panel rows from (capture, name, score, best target, liquid)."""
    out = [(DAYS[o], o + 1, DAYS[o - 1] if o else None, t, "Tech", "Hold", best, 100.0, 3.0, 4.0, DAYS[o], score, None, None, None, 1e9, None,
            10.0 * score, 20.0, ["S&P 500"], liquid, True) for o, t, score, best, liquid in rows]
    return spark.createDataFrame(out, (
        "as_of date, capture_ord int, prev_as_of date, ticker string, sector string, analyst_consensus string, best_analyst_price_target double, "
        "analyst_price_target double, analyst_price_target_upside_pct double, best_analyst_upside_pct double, rating_date date, smart_score double, "
        "insider_signal string, news_sentiment string, investor_sentiment string, market_cap double, dividend_yield double, tr_3m_pct double, "
        "vol_ann_pct double, member_of array<string>, liquid boolean, matched boolean"))


def test_revision_rows_are_dealt_out_once(spark):
    """Pairing, lens and chart flag go by name: only liquid rows are sent, once, and none is dealt out by capture and name again."""
    p = moving(spark, (0, "A", 5.0, 100.0, True), (1, "A", 6.0, 110.0, True))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dc.with_charts(rv.with_lens(rv.revision_rows(p), p), p)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert sorted(re.sub(r"#\d+", "", d) for d in dealt) == ["as_of", "ticker", "ticker", "ticker"]  # gate; pairs, lens, flags
    window = plan[plan.index("Window [lag"):]
    assert re.search(r"Filter .*liquid", window[: window.index("LogicalRDD") if "LogicalRDD" in window else window.index("Scan")])


def test_lens_of_revision_rows_is_that_of_their_capture(spark):
    """Repeated rows of a name meet all rows of the capture, rows without a lens row stay with nulls, gaps pair nothing."""
    p = moving(
        spark, (0, "A", 5.0, 100.0, True), (1, "A", 6.0, 110.0, True), (1, "A", 3.0, 90.0, True), (2, "A", 7.0, 130.0, True),
        (0, "B", 5.0, 100.0, True), (1, "B", 5.0, 120.0, False), (2, "B", 9.0, 140.0, True),
        (1, "C", 2.0, 100.0, True), (2, "C", 1.0, 50.0, True), (1, None, 2.0, 100.0, True), (2, None, 4.0, 50.0, True),
    )
    extra = p.where("capture_ord = 3 AND ticker = 'A'").withColumn("ticker", F.lit("Z"))  # a name the view does not have
    rows = rv.revision_rows(p)
    rows = rows.unionByName(rv.revision_rows(extra.unionByName(extra.withColumns({"capture_ord": F.lit(2), "smart_score": F.lit(1.0)})))).cache()
    assert sorted(r.ticker for r in rows.where("as_of = DATE '2026-01-16' AND ticker IS NOT NULL").collect()) == ["A", "C", "Z"]  # B has a gap
    got = rv.with_lens(rows, p)
    want = rows.join(cs.panel_view(p).select("as_of", "ticker", "lens_pass", "upside_per_vol"), ["as_of", "ticker"], "left")
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.where("ticker = 'A' AND as_of = DATE '2026-01-09'").count() > rows.where("ticker = 'A' AND as_of = DATE '2026-01-09'").count()
    assert got.where("lens_pass IS NULL").select("ticker").distinct().count() == 2  # Z and the nameless
