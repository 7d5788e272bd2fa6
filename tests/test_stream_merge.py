"""The capture log merged batch by batch: against a sequential pass, after replays, with late and odd records."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelflow.streaming import captures as stc
from panelflow.streaming import merge as mg

SCHEMA = "ticker string, at timestamp_ntz, level double"
DAY = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=31 * i)


def held_in(path, compact_every=2):
    return mg.LogMerge(str(path), "ticker", "at", ("level",), {"paired": F.count(F.lit(1)), "raises": F.count_if(F.col("level") > F.col("p.level"))}, compact_every)


def batches(seed, n=7):
    """Captures in order with some records moved to later batches, one capture that comes too late, and repeats."""
    rng = random.Random(seed)
    out = [[] for _ in range(n)]
    for i in range(3 * n):
        for t in "ABCDEFGH":
            if rng.random() < 0.8:
                at = min(n - 1, i // 3 + (rng.randint(1, 2) if rng.random() < 0.1 else 0))
                out[n - 1 if i == 4 else at].append((t, DAY(i), float(rng.randint(1, 9))))
    out[n // 2] += out[n // 2 - 1][:3] + out[n // 2][:2] + [(None, DAY(10), 1.0), ("A", None, 1.0)]
    return out


def sequential(arrived):
    """The same rules, record by record."""
    calendar, last, accepted, rejected = [], {}, [], []
    for batch in arrived:
        new = sorted({r[1] for r in batch if r[1] is not None and (not calendar or r[1] > calendar[-1])})
        calendar += new
        for r in sorted(batch, key=lambda r: (r[1] is None, r[1] or DAY(0))):
            if r[0] is None:
                rejected.append((r[0], r[1], mg.NO_KEY))
            elif r[1] not in calendar:
                rejected.append((r[0], r[1], mg.STALE))
            elif r[0] in last and r[1] <= last[r[0]][0]:
                rejected.append((r[0], r[1], mg.REPEATED if r[1] == last[r[0]][0] and last[r[0]][2] is batch else mg.NOT_LATER))
            else:
                before = last.get(r[0])
                accepted.append((r[0], calendar.index(r[1]), before and calendar.index(before[0])))
                last[r[0]] = (r[1], r[2], batch)
    return accepted, rejected, {t: v[0] for t, v in last.items()}


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_a_sequential_pass_also_when_batches_run_twice(spark, tmp_path, seed):
    arrived = batches(seed)
    accepted, rejected, last = sequential(arrived)
    for times in (1, 2):
        held = held_in(tmp_path / f"t{times}")
        frames = [spark.createDataFrame(b, SCHEMA) for b in arrived]
        log = frames[0].schema
        held.prepare(spark, log)
        for i, frame in enumerate(frames):
            for _ in range(times):
                held.merge(frame, i)
        got = [(r.ticker, r.capture_ord, r.p and r.p.capture_ord) for r in held.accepted(spark, log).collect()]
        assert order(got) == order(accepted)
        late = held.rejected(spark, log)
        assert order((r.ticker, r["at"], r.reason) for r in late.collect()) == order(rejected)
        assert {r.ticker: r["at"] for r in held.last_records(spark, log).collect()} == last
        want = {}
        for t, w, p in accepted:
            want[w] = want.get(w, 0) + (p == w - 1)
        assert {r.w: r.paired for r in held.window_rows(spark, log).collect()} == {w: n for w, n in want.items() if w > 0}


def test_a_batch_that_failed_half_way_leaves_nothing_behind_when_it_runs_again(spark, tmp_path, monkeypatch):
    arrived = [spark.createDataFrame(b, SCHEMA) for b in batches(3, 4)]
    log = arrived[0].schema
    whole, broken = held_in(tmp_path / "whole"), held_in(tmp_path / "broken")
    write = mg.LogMerge._write
    for held in (whole, broken):
        held.prepare(spark, log)
        for i, frame in enumerate(arrived):
            if held is broken:
                for stop in ("calendar", "records", "last", "windows"):  # fails right after this table was written
                    def failing(self, rows, name, *parts, stop=stop):
                        write(self, rows, name, *parts)
                        if name == stop:
                            raise OSError(name)
                    monkeypatch.setattr(mg.LogMerge, "_write", failing)
                    with pytest.raises(OSError):
                        held.merge(frame, i)
                monkeypatch.setattr(mg.LogMerge, "_write", write)
            held.merge(frame, i)
    for table in ("accepted", "rejected", "window_rows", "last_records"):
        rows = [getattr(held, table)(spark, log).drop("batch_id") for held in (whole, broken)]
        assert order(map(str, rows[0].collect())) == order(map(str, rows[1].collect()))


def test_compaction_bounds_what_a_batch_reads(spark, tmp_path):
    held = held_in(tmp_path / "c", compact_every=3)
    log = spark.createDataFrame([], SCHEMA).schema
    held.prepare(spark, log)
    for i in range(8):
        held.merge(spark.createDataFrame([("A" if i % 2 else "B", DAY(i), float(i))], SCHEMA), i)
    rows = held._read(spark, "last", log)
    assert {r.batch_id for r in rows.where("whole").collect()} == {3, 6}
    assert rows.where("whole AND batch_id = 6").count() == 2 and held.last_records(spark, log).count() == 2


def test_merge_runs_as_a_stream_without_python_in_its_plans(spark, tmp_path, monkeypatch):
    src, plans = str(tmp_path / "log"), []
    write = mg.LogMerge._write
    monkeypatch.setattr(mg.LogMerge, "_write", lambda self, rows, *a: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, *a)))
    held = held_in(tmp_path / "m")
    for part in (batches(5, 3)[0], batches(5, 3)[1]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = stc.capture_stream(spark, src, spark.read.parquet(src).schema)
        stc.run_available(stream, held.sink(stream), str(tmp_path / "state"))
    assert held.accepted(spark, stream.schema).count() > 20
    assert not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "TransformWithState"))


def test_empty_batches_and_a_clashing_column(spark, tmp_path):
    held = held_in(tmp_path / "e")
    none = spark.createDataFrame([], SCHEMA)
    held.prepare(spark, none.schema)
    held.merge(none, 0)
    assert held.window_rows(spark, none.schema).isEmpty() and held.rejected(spark, none.schema).isEmpty()
    with pytest.raises(ValueError):
        held.merge(none.withColumn("capture_ord", F.lit(1)), 1)
