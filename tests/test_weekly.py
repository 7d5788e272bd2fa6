"""Two exports through the whole weekly flow."""

import datetime as dt

import pytest

from panelflow.operators import revision as rv
from panelflow.plans import weekly
from panelflow.sources import store


def export(path, rows):
    head = "Ticker,Name,Sector,Market Cap,Smart Score,Analyst Consensus,Best Analyst Consensus,Analyst Price Target,Best Price Target Upside,Last Rating Date,Insider Signal\n"
    path.write_text(head + "".join(",".join(r) + "\n" for r in rows), encoding="utf-8")


def row(t, label, target, day):
    return (t, t.title(), "Tech", "$5B", "8", label, label, "$100", target, f'"{day}"', "")


def test_two_weeks_end_to_end(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("snap", "panel", "doc")}
    export(tmp_path / "w1.csv", [row("aaa", "Hold", "$100", "Jul 20, 2026"), row("bbb", "Hold", "$50", "Jul 01, 2026"), row("ccc", "Hold", "$50", "Jul 01, 2026")])
    export(tmp_path / "w2.csv", [row("aaa", "Strong Buy", "$110", "Aug 05, 2026"), row("bbb", "Hold", "$40", "Jul 01, 2026")])
    bars = spark.createDataFrame([(s, dt.date(2026, 7, 1) + dt.timedelta(days=i), 50.0, 50.0, 1e6) for s in ("AAA", "BBB", "CCC") for i in range(40)],
                                 "symbol string, session date, close double, close_capital double, volume double")
    member = spark.createDataFrame([(s, "S&P 500", dt.date(2026, 7, 1), 1) for s in ("AAA", "BBB", "CCC")], "symbol string, index_name string, session date, is_member int")
    for day, name in (("2026-07-31", "w1.csv"), ("2026-08-07", "w2.csv")):
        snap = weekly.capture(spark, [str(tmp_path / name)], day, p["snap"], today="2026-08-10", row_tolerance=0.5, min_overlap=0.5)  # one of three names leaves
        panel = weekly.merge(snap, bars, member, p["panel"])
    with pytest.raises(FileExistsError):
        weekly.capture(spark, [str(tmp_path / "w2.csv")], "2026-08-07", p["snap"])
    rows = weekly.ordered_panel(panel)
    r = rv.pair_counts(rows).first()
    assert (r["pairs"], r["upgrades"], r["confirmed_up"], r["target_raises"], r["target_cuts"], r["left_n"]) == (2, 1, 1, 1, 1, 1)
    assert rv.left_names(rows).first()["reason"] == "absent from this week's export"
    weekly.publish(panel, p["doc"])
    assert spark.read.json(p["doc"]).where("section = 'weekly'").count() == 2
    leaky = panel.withColumn("sector", panel["ticker"])
    with pytest.raises(ValueError, match="AAA"):
        weekly.publish(leaky, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_a_bad_export_leaves_nothing(spark, tmp_path):
    snap = str(tmp_path / "snap")
    full = [row(f"t{i}", "Hold", "$50", "Jul 01, 2026") for i in range(30)]
    export(tmp_path / "w1.csv", full)
    take = lambda name, day, **k: weekly.capture(spark, [str(tmp_path / name)], day, snap, today="2026-08-10", **k)
    with pytest.raises(ValueError, match="future"):
        take("w1.csv", "2026-08-11")
    assert not (tmp_path / "snap").exists() and not (tmp_path / "snap-headers").exists()
    assert take("w1.csv", "2026-07-31").count() == 30
    with pytest.raises(ValueError, match="fresh"):
        take("w1.csv", "2026-08-07")
    export(tmp_path / "short.csv", full[:20])
    with pytest.raises(ValueError, match="row count"):
        take("short.csv", "2026-08-07")
    (tmp_path / "lost.csv").write_text((tmp_path / "w1.csv").read_text().replace("Smart Score", "Points"))
    with pytest.raises(ValueError, match="column regression"):
        take("lost.csv", "2026-08-07")
    assert {r["as_of"].day for r in store.load_stream(spark, snap, "weekly").select("as_of").distinct().collect()} == {31}
    # a daily capture follows the weekly one, then its own stream by time
    export(tmp_path / "d1.csv", [*full[:29], row("new", "Hold", "$50", "Jul 01, 2026")])
    assert take("d1.csv", "2026-08-03", stream="daily", hhmm="0746", fallback="weekly").count() == 30
    with pytest.raises(ValueError, match="fresh"):
        take("d1.csv", "2026-08-03", stream="daily", hhmm="2200", fallback="weekly")
    heads = {(r["stream"], r["hhmm"]): r for r in store.load_headers(spark, snap).collect()}
    assert set(heads) == {("weekly", ""), ("daily", "0746")}
    kept = heads["daily", "0746"]
    assert (kept["n_raw"], kept["n_rows"], kept["n_dropped"], kept["files"]) == (30, 30, 0, ["d1.csv"]) and len(kept["sha256"]) == 1


def test_a_stale_feed_stops_the_merge(spark, tmp_path):
    proof = spark.createDataFrame([(False, True, True)], "fresh boolean, delisted_ok boolean, membership_ok boolean")
    with pytest.raises(ValueError, match="fresh"):
        weekly.merge(proof, proof, proof, str(tmp_path / "panel"), proof=proof)
    assert not (tmp_path / "panel").exists()
