"""Event-log sweep, flow and reversion against brute force; streaming against batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelflow.operators import eventlog as ev
from panelflow.operators import identity as idn
from panelflow.streaming import captures as stc

D = dt.date
LABELS = ["Strong Buy", "Moderate Buy", "Hold", "Moderate Sell", "Strong Sell"]
LOG = "capture_ord int, cap_ts timestamp_ntz, et timestamp_ntz, ticker string, analyst_consensus string, best_analyst_price_target double, rating_date date"


@pytest.fixture(scope="module")
def log():
    rng = random.Random(9)
    times = sorted(dt.datetime(2026, 8, 1, 20) + dt.timedelta(hours=h) for h in (0, 5, 14, 31, 50, 77, 120, 168))
    caps = [(i, t, t - dt.timedelta(hours=12)) for i, t in enumerate(times)]
    recs = []
    for n in range(40):
        label, target, rd = rng.choice(LABELS), 100.0 + rng.randint(0, 3), D(2026, 7, 31)
        for i, t, et in caps:
            if rng.random() < 0.15:
                continue  # missing from this capture
            if rng.random() < 0.4:
                label = rng.choice([*LABELS, None, "Odd"])
                rd = rng.choice([None, et.date(), et.date() - dt.timedelta(days=rng.randint(0, 4))])
            if rng.random() < 0.4:
                target = rng.choice([None, 0.0, 100.0, 100.2, 100.5, 101.0, 103.0])
            recs.append((i, t, et, f"T{n}", label, target, rd))
    return caps, recs


@pytest.fixture(scope="module")
def frames(spark, log):
    caps, recs = log
    return (spark.createDataFrame(recs, LOG).repartition(6), spark.createDataFrame(caps, "capture_ord int, cap_ts timestamp_ntz, et timestamp_ntz"))


def test_sweep_equals_pairwise_comparison(frames, log):
    caps, recs = log
    by = {(r[0], r[3]): r for r in recs}
    got = {(r["a_ord"], r["b_ord"]): r for r in ev.confirmation_sweep(*frames).collect()}
    assert len(got) == len(caps) * (len(caps) - 1) // 2
    for (i, _, ea) in caps:
        for (j, _, eb) in caps[i + 1:]:
            paired = up = down = conf = 0
            for n in range(40):
                x, y = by.get((i, f"T{n}")), by.get((j, f"T{n}"))
                if not x or not y or x[4] not in LABELS or y[4] not in LABELS:
                    continue
                paired += 1
                a, b = LABELS.index(x[4]), LABELS.index(y[4])
                up, down = up + (b < a), down + (b > a)
                conf += a != b and y[6] is not None and ea.date() <= y[6] <= eb.date()
            r = got[i, j]
            assert (r["paired"], r["up"], r["down"], r["confirmed"]) == (paired, up, down, conf), (i, j)
            assert r["span"] == (eb.date() - ea.date()).days + 1


def test_summaries_cover_the_sweep(frames):
    sweep = ev.confirmation_sweep(*frames)
    useful = ev.useful_pairs(sweep).count()
    assert ev.by_elapsed(sweep).agg(F.sum("pairs")).first()[0] == useful == ev.by_span(sweep).agg(F.sum("pairs")).first()[0]
    assert ev.by_elapsed(sweep).count() == 4
    assert {r["half"] for r in ev.within_span(sweep).collect()} <= {"shorter", "longer"}


@pytest.mark.parametrize("floor,strict", [(0.25, False), (0.0, False), (0.0, True)])
def test_flow_windows(frames, log, floor, strict):
    caps, recs = log
    by = {(r[0], r[3]): r for r in recs}
    got = {r["w"]: r for r in ev.flow_windows(*frames, floor, strict).collect()}
    for i, (_, _, ea) in enumerate(caps[:-1]):
        eb = caps[i + 1][2]
        paired = raises = cuts = dated = 0
        for n in range(40):
            x, y = by.get((i, f"T{n}")), by.get((i + 1, f"T{n}"))
            if not x or not y or not x[5] or y[5] is None:
                continue
            paired += 1
            pct = (y[5] - x[5]) / x[5] * 100
            if abs(pct) < floor or (not strict and pct == 0):
                continue  # with a floor of 0 and `strict`, an unmoved name counts as a cut
            raises, cuts = raises + (pct > 0), cuts + (pct <= 0)
            dated += y[6] is not None and ea.date() <= y[6] <= eb.date()
        r = got[i + 1]
        assert (r["paired"], r["raises"], r["cuts"], r["moves"]) == (paired, raises, cuts, raises + cuts)
        assert r["dated_share"] == (pytest.approx(dated / (raises + cuts), abs=5e-5) if raises + cuts else None)


def test_duplicate_capture_is_flagged(spark):
    t = dt.datetime(2026, 8, 1)
    mk = lambda o, k, v: (o, t + dt.timedelta(days=o), t + dt.timedelta(days=o), k, "Hold", v, None)
    df = spark.createDataFrame([mk(0, "A", 100.0), mk(1, "A", 110.0), mk(2, "A", 121.0), mk(0, "B", 50.0), mk(1, "B", 55.0), mk(2, "B", 60.5)], LOG)
    r = ev.flow_overlap(df).first()
    assert (r["shared"], r["identical"], r["duplicate"]) == (2, 2, True)


def test_identity_classes(spark):
    t = dt.datetime(2026, 8, 1)
    series = {
        "BACK": [(111.71, D(2026, 7, 14)), (111.05, D(2026, 7, 14)), (111.71, None)],
        "MOVE": [(100.0, D(2026, 7, 1)), (101.0, D(2026, 8, 1)), (102.0, D(2026, 8, 2))],
        "FLAT": [(5.0, None)] * 3,
        "ZERO": [(5.0, None), (0.0, None), (5.0, None)],
        "GONE": [(5.0, None), (6.0, None)],
    }
    rows = [(o, t, t, k, None, v, rd) for k, s in series.items() for o, (v, rd) in enumerate(s)]
    caps = spark.createDataFrame([(o,) for o in range(3)], "capture_ord int")
    df = spark.createDataFrame(rows, LOG)
    got = {r["ticker"]: (r["moves"], r["reverted"], r["rating_static"]) for r in idn.classify(df, caps).collect()}
    assert got == {"BACK": (2, True, True), "MOVE": (2, False, False), "FLAT": (0, False, True)}
    strict = {r["ticker"]: r["moves"] for r in idn.classify(df, caps, 0.0, True).collect()}
    assert strict["FLAT"] == 2  # unmoved names count as moves under a floor of 0
    cells = {(r["rating_static"], r["reverted"]): (r["names"], r["moves"]) for r in idn.contingency(idn.classify(df, caps)).collect()}
    assert cells == {(True, True): (1, 2), (True, False): (0, 0), (False, True): (0, 0), (False, False): (1, 2)}
    assert [r["ticker"] for r in idn.examples(idn.classify(df, caps), 5).collect()] == ["BACK"]


def test_z_test_reference_value(spark):
    """Shares of 18 and 9 percent on arms of 189 and 986 names."""
    arms = [(f"s{i}", 1, i < 34, True) for i in range(189)] + [(f"c{i}", 1, i < 87, False) for i in range(986)]
    r = idn.z_test(spark.createDataFrame(arms, "ticker string, moves int, reverted boolean, rating_static boolean")).first()
    assert r["z"] == pytest.approx(3.80, abs=0.05) and r["p_value"] < 0.001 and r["discriminates"] and not r["caution"]
    empty = idn.z_test(spark.createDataFrame([("a", 1, True, True)], "ticker string, moves int, reverted boolean, rating_static boolean")).first()
    assert empty["z"] is None and empty["caution"]


def test_stream_equals_batch_and_rejects_late(spark, frames, tmp_path):
    log, _ = frames
    narrow = log.select("ticker", "capture_ord", "analyst_consensus", "best_analyst_price_target")
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    # several captures of a key in one batch, then the rest, then a capture that is too late
    for part in (narrow.where("capture_ord <= 4"), narrow.where("capture_ord > 4"), narrow.where("capture_ord = 3 AND ticker = 'T1'")):
        part.write.mode("append").parquet(src)
        s = stc.with_previous(stc.capture_stream(spark, src, narrow.schema), "ticker", "capture_ord", ["analyst_consensus", "best_analyst_price_target"])
        stc.run_available(s, stc.batch_writer(out), state)
    got = spark.read.parquet(out)
    late = got.where("late").collect()
    assert all(r["p"] is None for r in late) and len(late) == narrow.where("capture_ord = 3 AND ticker = 'T1'").count()
    streamed = stc.adjacent_only(got).select("ticker", "capture_ord", F.col("p.best_analyst_price_target").alias("prev"))
    a = narrow.alias("a")
    batch = narrow.select("ticker", (F.col("capture_ord") + 1).alias("capture_ord"), F.col("best_analyst_price_target").alias("prev")).join(
        a, ["ticker", "capture_ord"]).select("ticker", "capture_ord", "prev")
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_stream_gap_report(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(D(2026, 8, 4),), (D(2026, 8, 7),)], "as_of date").write.parquet(src)
    sessions = spark.createDataFrame([(D(2026, 8, d),) for d in (3, 4, 5, 6, 7)], "session date")
    stream = stc.capture_stream(spark, src, spark.read.parquet(src).schema)
    stc.run_available(stream, stc.gap_reporter(sessions, str(tmp_path / "out")), str(tmp_path / "state"))
    got = {r["session"].day: r["covered"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {3: True, 4: False, 5: False, 6: True}
