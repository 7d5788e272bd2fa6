"""Capture integrity checks and the reference-data gate, as tables of (check, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.schema import CORE_FIELDS, MIN_OVERLAP, ROW_TOLERANCE


def prior_captures(captures: DataFrame, stream: str, fallback: str | None = None) -> DataFrame:
    """Newest earlier capture of each capture of `stream`, else the newest earlier of `fallback`.

    Keys are (as_of, hhmm) in lexical order; an untimed capture sorts first on its day. The
    capture dimension has one row per capture, so one ordered window is bounded.
    """
    key = F.struct("as_of", "hhmm")
    rows = captures.where(F.col("stream").isin([s for s in (stream, fallback) if s])).withColumn("key", key)
    # streams may share a key: step back over the distinct key list
    keys = (
        rows.groupBy("key")
        .agg(F.bool_or(F.col("stream") == stream).alias("_main"), F.bool_or(F.col("stream") == F.lit(fallback)).alias("_fall"))
    )
    past = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    prior = keys.select(
        "key",
        F.max(F.when(F.col("_main"), F.col("key"))).over(past).alias("main"),
        F.max(F.when(F.col("_fall"), F.col("key"))).over(past).alias("fall"),
    )
    return (
        rows.where(F.col("stream") == stream)
        .join(prior, "key")
        .select(
            "as_of", "hhmm",
            F.when(F.col("main").isNotNull(), F.lit(stream)).when(F.col("fall").isNotNull(), F.lit(fallback)).alias("prior_stream"),
            F.coalesce("main", "fall").getField("as_of").alias("prior_as_of"),
            F.coalesce("main", "fall").getField("hhmm").alias("prior_hhmm"),
        )
    )


def capture_checks(
    headers: DataFrame, members: DataFrame, today: str | None, force: bool = False,
    row_tolerance: float = ROW_TOLERANCE, min_overlap: float = MIN_OVERLAP,
) -> DataFrame:
    """Every integrity check of every capture against the capture before it; `today` None is the current date.

    `headers`: one row per capture with capture_ord, as_of, hhmm (optional), n_raw (rows of the export), n_rows
    (distinct keys), mapped_fields, unmapped_columns, sha256 (array) and copies (captures filed
    under the key). `members`: distinct (capture_ord, ticker).
    """
    c = F.col
    step = Window.orderBy("capture_ord")
    w = Window.partitionBy("ticker").orderBy("capture_ord")
    overlap = (
        members.withColumn("_again", F.lag("capture_ord").over(w) == c("capture_ord") - 1)
        .groupBy("capture_ord")
        .agg(F.count_if("_again").alias("n_common"))
    )
    # captures of one day are told apart by their time, where headers carry it
    headers = headers if "hhmm" in headers.columns else headers.withColumn("hhmm", F.lit(""))
    prior = F.lag(F.struct("as_of", "hhmm", "n_rows", "mapped_fields", "unmapped_columns", "sha256")).over(step)
    rows = headers.withColumn("p", prior).join(overlap, "capture_ord", "left").withColumn(
        "n_common", F.coalesce("n_common", F.lit(0))
    )
    has = c("p").isNotNull()
    core = F.array(*[F.lit(f) for f in CORE_FIELDS])
    missing = F.array_except(core, c("mapped_fields"))
    lost = F.array_except(F.array_intersect(c("p.mapped_fields"), core), c("mapped_fields"))
    fresh_headers = F.array_except(c("unmapped_columns"), c("p.unmapped_columns"))
    drift = F.try_divide(c("n_raw") - c("p.n_rows"), c("p.n_rows"))
    share = F.coalesce(F.try_divide(c("n_common"), c("p.n_rows")), F.lit(0.0))
    same = F.arrays_overlap(c("sha256"), c("p.sha256"))
    listed = lambda a: F.concat_ws(",", F.array_sort(a))
    pct = lambda x: F.round(x * 100.0, 4).cast("string")

    def check(name: str, ok: Column, detail: Column, applies: Column = F.lit(True)) -> Column:
        body = F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
        return F.when(applies, body)

    checks = F.array_compact(
        F.array(
            check("file readable", c("n_raw") > 0, c("n_raw").cast("string")),
            check("core columns present", F.size(missing) == 0, listed(missing)),
            check("no column regression", F.size(lost) == 0, listed(lost), has),
            check("unmapped columns", F.lit(True), listed(fresh_headers), has),
            check("row count vs prior", F.abs(drift) <= row_tolerance, pct(drift), has),
            check("key overlap vs prior", share >= min_overlap, pct(share), has),
            check("export is fresh", ~F.coalesce(same, F.lit(False)), F.lit(""), has),
            check("prior capture", F.lit(True), F.lit("none found"), ~has),
            check("as-of not in the future", c("as_of") <= (F.to_date(F.lit(today)) if today else F.current_date()), c("as_of").cast("string")),
            check(
                "capture is after the prior one", F.struct("as_of", "hhmm") > F.struct(c("p.as_of"), c("p.hhmm")),
                c("p.as_of").cast("string"), has,
            ),
            check("not already captured", F.lit(force) | (c("copies") <= 1), c("copies").cast("string")),
        )
    )
    return rows.select("as_of", F.inline(checks))


def gate(checks: DataFrame) -> None:
    """Stop before anything is written when a check failed (the check table is small)."""
    failed = checks.where("NOT ok").collect()  # a few checks per capture
    if failed:
        raise ValueError("capture refused: " + "; ".join(f"{r['check']} ({r['detail']})" for r in failed))


def last_completed_session(calendar: DataFrame, now: str) -> Column:
    """Newest session whose close instant has passed, as a scalar."""
    instant = F.lit(now).cast("timestamp_ntz")
    return calendar.where(F.col("close_ts").cast("timestamp_ntz") <= instant).agg(F.max("session")).scalar()


def feed_gate(bars: DataFrame, benchmarks: DataFrame, delisted: DataFrame, membership: DataFrame, calendar: DataFrame, now: str) -> DataFrame:
    """One row of proof: freshness of the benchmarks, delisted table, usable membership."""
    last = bars.join(benchmarks, "symbol", "left_semi").groupBy("symbol").agg(F.max("session").alias("last_bar"))
    member_days = membership.join(benchmarks, "symbol", "left_semi").agg(F.coalesce(F.sum("is_member"), F.lit(0))).scalar()
    n_delisted = delisted.agg(F.count(F.lit(1))).scalar()
    wanted = benchmarks.agg(F.count(F.lit(1))).scalar()
    c = F.col
    return (
        last.agg(F.min("last_bar").alias("oldest_benchmark_bar"), F.count(F.lit(1)).alias("benchmarks_found"))
        .withColumn("last_completed_session", last_completed_session(calendar, now))
        .withColumn("delisted_symbols", n_delisted)
        .withColumn("member_days", member_days)
        .withColumn(
            "fresh",
            F.coalesce((c("benchmarks_found") == wanted) & (c("oldest_benchmark_bar") >= c("last_completed_session")), F.lit(False)),
        )
        .withColumn("delisted_ok", c("delisted_symbols") > 0)
        .withColumn("membership_ok", c("member_days") > 0)
    )


def session_coverage(captures: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions between the first and last anchor with a covered flag.

    A capture reflects the last session on or before the day before it. Sessions and captures
    hold one row per calendar day at most, so the single ordered window is bounded.
    """
    days = captures.select(F.date_sub("as_of", 1).alias("d")).distinct()
    both = sessions.select(F.col("session").alias("d"), F.col("session")).unionByName(
        days.select("d", F.lit(None).cast("date").alias("session"))
    )
    upto = Window.orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    anchored = both.withColumn("anchor", F.max("session").over(upto))
    covered = anchored.where("session IS NULL AND anchor IS NOT NULL").select(F.col("anchor").alias("session")).distinct()
    span = covered.agg(F.struct(F.min("session").alias("lo"), F.max("session").alias("hi"))).scalar()
    inside = sessions.withColumn("_s", span).where(F.col("session").between(F.col("_s.lo"), F.col("_s.hi"))).drop("_s")
    return inside.join(covered.withColumn("covered", F.lit(True)), "session", "left").withColumn(
        "covered", F.coalesce("covered", F.lit(False))
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count_if("covered").alias("covered"),
        F.count(F.lit(1)).alias("in_range"),
        F.round(F.try_divide(F.count_if("covered"), F.count(F.lit(1))), 4).alias("share"),
        F.max(F.when(F.col("covered"), F.col("session"))).alias("latest_anchor"),
    )


def slot_split(captures: DataFrame, opening: str = "2130") -> DataFrame:
    """Timed captures before and after the US open, untimed apart."""
    timed = F.col("hhmm") != ""
    return captures.agg(
        F.count_if(timed & (F.col("hhmm") < opening)).alias("post_close"),
        F.count_if(timed & (F.col("hhmm") >= opening)).alias("intraday"),
        F.count_if(~timed).alias("untimed"),
    )


def refuse_feed(proof: DataFrame) -> None:
    """Stop before a merge when the one row of `feed_gate` is missing or holds a failed check."""
    row = proof.select("fresh", "delisted_ok", "membership_ok").first()
    failed = [k for k, ok in row.asDict().items() if not ok] if row else ["no proof"]
    if failed:
        raise ValueError("reference data refused: " + ", ".join(failed))
