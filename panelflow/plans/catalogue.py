"""Registered queries: name -> function of (spark, table folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions import cells, clock
from panelflow.functions import signals as sg
from panelflow.operators import asof as ao
from panelflow.operators import crosssection as cs
from panelflow.operators import eventlog as ev
from panelflow.operators import grading as gr
from panelflow.operators import guards as gd
from panelflow.operators import identity as idn
from panelflow.operators import inference as inf
from panelflow.operators import portfolio as pf
from panelflow.operators import quality as ql
from panelflow.operators import returns as rt
from panelflow.operators import revision as rv
from panelflow.operators import schemes as sc
from panelflow.operators import universe as un
from panelflow.plans import weekly
from panelflow.sources import driver_tables as dt
from panelflow.session import attach, scratch_path, stored
from panelflow.sources import exports as ex
from panelflow.sources import store as st
from panelflow.streaming import captures as stc
from panelflow.streaming import merge as mg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return keep


def on_panel(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(dt.ratings_panel(spark, sf_dir))


# ---- revision ------------------------------------------------------------------------------
on_panel("revision_pair_counts", rv.pair_counts)
on_panel("revision_rows_scored", rv.revision_rows)
on_panel("revision_view_counts", rv.view_counts)
on_panel("revision_sector_breadth_all", rv.breadth_public)
on_panel("revision_sector_breadth_emitted", rv.breadth_view)
on_panel("revision_entered", rv.entered)
on_panel("revision_left_reason", rv.left_names)
on_panel("weekly_series", rv.weekly_series)

# ---- cross-section -------------------------------------------------------------------------
on_panel("week_aggregates", cs.week_aggregates)
on_panel("consensus_mix", cs.consensus_mix)
on_panel("score_histogram", cs.score_histogram)
on_panel("sector_summary", cs.sector_summary)
on_panel("index_counts", cs.index_counts)
on_panel("panel_view", cs.panel_view)
on_panel("lens_flags", cs.lens_counts)
on_panel("sector_percent_rank", cs.sector_percent_rank)
on_panel("sector_leaders", cs.sector_leaders)
on_panel(
    "stance_counts",
    lambda p: cs.stance_counts(p, ["insider_signal", "investor_sentiment", "news_sentiment"]),
)


@query("flow_tally")
def flow_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = dt.ratings_panel(spark, sf_dir)
    axes = {"insider": "insider_signal", "investor": "investor_sentiment", "news": "news_sentiment"}
    return reduce(
        DataFrame.unionByName,
        [cs.category_counts(panel, f).withColumn("axis", F.lit(a)) for a, f in axes.items()],
    )


@query("accrual")
def accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.accrual(dt.panel_captures(spark, sf_dir), "2001-01-15")


# ---- universe and liquidity ----------------------------------------------------------------
BAR_ADV_FLOOR = 20_000.0  # the brand bars trade in thousands, not millions


@query("symbol_resolution")
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickers = dt.export_tickers(spark, sf_dir).select("ticker").distinct()
    return un.resolve_symbols(tickers, dt.bars(spark, sf_dir)).withColumn(
        "matched", F.col("feed_symbol").isNotNull()
    )


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("adv_median_21")
def adv_median_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(un.dollar_volume(dt.bars(spark, sf_dir)), adv_usd=4)


@query("return_63")
def return_63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(un.trend(dt.bars(spark, sf_dir)).select("symbol", "session", "tr_3m_pct"), tr_3m_pct=6)


@query("vol_63")
def vol_63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(un.trend(dt.bars(spark, sf_dir)).select("symbol", "session", "vol_ann_pct"), vol_ann_pct=6)


@query("chart_ma")
def chart_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return un.chart_history(dt.bars(spark, sf_dir), as_of="2000-12-31")


@query("asof_membership")
def asof_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per (customer, priority class) at each capture, from the change-compacted series."""
    series = dt.order_membership(spark, sf_dir).withColumn("_k", F.struct("symbol", "index_name"))
    state = ao.state_at_captures(
        series, "_k", "session", [], ["is_member"], dt.panel_captures(spark, sf_dir)
    )
    return state.where("is_member = 1").select("_k.symbol", "_k.index_name", "as_of", "is_member")


@query("asof_anchor_close")
def asof_anchor_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = dt.bars(spark, sf_dir)
    anchors = _anchors(bars, dt.panel_captures(spark, sf_dir))
    out = ao.asof_join(
        anchors,
        bars.select("symbol", "session", F.col("session").alias("anchor_date"), F.col("close").alias("close_tr")),
        ["symbol"], "as_of", "session", ["anchor_date", "close_tr"],
        bucket=F.year("session"), left_bucket=F.year("as_of"),
    )
    return _rounded(out, close_tr=6)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dt.panel_captures(spark, sf_dir).agg(F.sort_array(F.collect_set("as_of"))).scalar()
    snapshot = dt.export_tickers(spark, sf_dir).withColumn("as_of", F.explode(days))
    bars = stored(dt.bars(spark, sf_dir), "bars")  # spellings, statistics and anchors all read them
    return un.merge_panel(snapshot, bars, dt.brand_membership(spark, sf_dir), adv_floor=BAR_ADV_FLOOR)


@query("panel_merge")
def panel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rounded(_merged(spark, sf_dir), close_tr=6, adv_usd=4, tr_3m_pct=6, vol_ann_pct=6)
    return out.withColumn("member_of", F.array_join("member_of", "|"))


@query("liquid_funnel")
def liquid_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return un.funnel(_merged(spark, sf_dir))


# ---- event log -----------------------------------------------------------------------------


def on_log(name: str, operator: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        captures = dt.event_instants(spark, sf_dir)
        return operator(dt.event_log(spark, sf_dir, captures), captures)

    QUERIES[name] = run


on_log("confirm_sweep_pairs", ev.confirmation_sweep)
on_log("confirm_by_elapsed", lambda log, caps: ev.by_elapsed(ev.confirmation_sweep(log, caps)))
on_log("confirm_by_span", lambda log, caps: ev.by_span(ev.confirmation_sweep(log, caps)))
on_log("confirm_within_span", lambda log, caps: ev.within_span(ev.confirmation_sweep(log, caps)))
on_log("target_flow_windows", ev.flow_windows)
on_log("target_flow_overlap", lambda log, caps: ev.flow_overlap(log))
on_log("target_flow_night_day", lambda log, caps: ev.night_and_day(ev.flow_windows(log, caps)))
on_log("identity_classify", idn.classify)
on_log("identity_contingency", lambda log, caps: idn.contingency(idn.classify(log, caps)))
on_log("identity_ztest", lambda log, caps: idn.z_test(idn.classify(log, caps)))
on_log("present_throughout", idn.present_throughout)


# ---- cells, ingest, checks, guards ---------------------------------------------------------


@query("numeric_cells")
def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.number_cells(spark, sf_dir).select(
        "event_id",
        cells.numeric_cell(F.col("cell")).alias("number"),
        cells.suspicious_number(F.col("cell")).alias("suspicious"),
    )


@query("rating_date_parse")
def rating_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.date_cells(spark, sf_dir).select(
        "o_orderkey",
        cells.rating_date_lenient(F.col("cell")).alias("lenient"),
        cells.rating_date_strict(F.col("cell")).alias("strict"),
    )


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dt.raw_export(spark, sf_dir).withColumnRenamed("as_of", "_quarter")
    return ex.snapshot(raw, F.col("_quarter"), ["_page", "_row", "_quarter"]).drop("_quarter")


@query("dedupe_keep_first")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select("as_of", "ticker", "_page", "_row", "n_dropped")


@query("ingest_snapshot")
def ingest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select(
        "as_of", "ticker", "company", "sector", "price", "best_analyst_price_target", "best_analyst_upside_pct",
        "analyst_price_target_upside_pct", "analyst_price_target", "analyst_consensus", "last_rating_date",
        "smart_score", "insider_signal", "dividend_yield", "n_dropped",
    )


@query("capture_header")
def capture_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dt.raw_export(spark, sf_dir)
    mapping, unmapped = ex.map_headers([c for c in raw.columns if c not in ("as_of", "_page", "_row")])
    return ex.capture_header(_snapshot(spark, sf_dir), mapping, unmapped).select(
        "schema_version", "as_of", "as_of_weekday", "as_of_is_weekend", "n_rows", "n_dropped",
        F.array_join("unmapped_columns", ",").alias("unmapped"),
    )


@query("dq_checks")
def dq_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, members = dt.capture_headers(spark, sf_dir)
    return ql.capture_checks(headers, members, today="2001-06-01")


@query("capture_flow")
def capture_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of seven capture attempts over CSV exports of the orders, whether each was filed, and what the store holds then.

    Filed: the three periods. Refused: the first export again under a later key, the second without its score column, a
    second capture under a filed key, and one dated after today.
    """
    root = scratch_path(spark, "flow")
    exports, snaps = f"{root}/exports", f"{root}/snapshots"
    dt.period_exports(spark, sf_dir, exports)
    lost = spark.read.option("header", True).csv(f"{exports}/period=2").drop("page").withColumnRenamed("Smart Score", "Points")
    lost.write.option("header", True).csv(f"{root}/lost")
    days = [day for _, _, day in dt.PERIODS]
    attempts = [
        ("period=1", days[0]), ("period=1", "1997-06-30"), (None, "1998-06-30"), ("period=2", days[1]),
        ("period=3", days[1]), ("period=3", days[2]), ("period=3", "2002-06-30"),
    ]
    said = []
    for no, (name, day) in enumerate(attempts, 1):
        source = f"{exports}/{name}" if name else f"{root}/lost"
        records, header, checks = weekly.examine(spark, [source], day, snaps, today="2002-01-31", row_tolerance=5.0, min_overlap=0.3)
        mine = stored(checks.where(F.col("as_of") == F.to_date(F.lit(day))), "checks")
        passed = mine.where("NOT ok").isEmpty()
        if passed:
            st.file_capture({snaps: records, st.header_path(snaps): header}, "weekly", day, "", snaps)
        outcome = spark.range(1).select(
            F.to_date(F.lit(day)).alias("as_of"), F.lit("filed").alias("check"), F.lit(passed).alias("ok"), F.lit("").alias("detail"))
        said.append(mine.unionByName(outcome).withColumn("attempt", F.lit(no)))
    held = st.load_stream(spark, snaps, "weekly").groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("bigint").alias("price"), F.sum("n_dropped").alias("dropped"))
    heads = st.load_headers(spark, snaps).select("as_of", "n_raw", F.array_join("unmapped_columns", ",").alias("unmapped"))
    detail = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("n", "price", "dropped", "n_raw", "unmapped")])
    kept = held.join(heads, "as_of").select("as_of", F.lit("held").alias("check"), F.lit(True).alias("ok"), detail.alias("detail"), F.lit(0).alias("attempt"))
    return reduce(DataFrame.unionByName, said).unionByName(kept).select("attempt", "as_of", "check", "ok", "detail")


@query("quarantined_documents")
def quarantined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable and quarantined records per file of a JSON store in which the texts of one language were written unquoted."""
    root = scratch_path(spark, "documents")
    docs = dt.table(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "lang", F.length("text").alias("n")))
    torn = F.concat(F.lit("{"), F.substring(line, 3, 10_000))  # without its first quote mark
    rows = docs.select(F.when(F.col("lang") == "de", torn).otherwise(line).alias("value"), F.coalesce("source", F.lit("none")).alias("source"))
    rows.repartition("source").write.partitionBy("source").text(f"{root}/lines")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n", T.LongType())])
    good, bad = st.scan_json_captures(spark, f"{root}/lines", schema, multi_line=False)
    return good.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("n").cast("bigint").alias("chars")).join(
        bad.groupBy("source").agg(F.count(F.lit(1)).alias("quarantined"), F.sum(F.length("record")).cast("bigint").alias("held_chars")), "source", "full").select(
        "source", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("chars", F.lit(0)).alias("chars"),
        F.coalesce("quarantined", F.lit(0)).alias("quarantined"), F.coalesce("held_chars", F.lit(0)).alias("held_chars"))


@query("asof_prior_capture")
def asof_prior_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.prior_captures(dt.both_streams(spark, sf_dir), "daily", "weekly")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.session_coverage(dt.panel_captures(spark, sf_dir), dt.sessions(spark, sf_dir))


QUERIES["session_coverage"] = _coverage
QUERIES["coverage_summary"] = lambda spark, sf_dir: ql.coverage_summary(_coverage(spark, sf_dir))
QUERIES["slot_split"] = lambda spark, sf_dir: ql.slot_split(dt.both_streams(spark, sf_dir).where("stream = 'daily'"))


@query("feed_gate")
def feed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = dt.bars(spark, sf_dir)
    benchmarks = bars.select("symbol").distinct().where(F.col("symbol").isin("BRAND-1", "BRAND-2", "BRAND-3"))
    last = dt.part_bars(spark, sf_dir).groupBy("symbol").agg(F.max("session").alias("last_session"))
    delisted = last.where("last_session < DATE '2001-01-01'")
    closes = (F.col("session").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOURS")).alias("close_ts")
    calendar = dt.sessions(spark, sf_dir).select("session", closes)
    return ql.feed_gate(bars, benchmarks, delisted, dt.brand_membership(spark, sf_dir), calendar, "2001-06-30 12:00:00")


@query("leak_scan")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gd.leaked_keys(dt.quoted_keys(spark, sf_dir), dt.table(spark, sf_dir, "pages"), "html", "page_id")


@query("guard_marker_scan")
def guard_marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rv.revision_rows(dt.ratings_panel(spark, sf_dir))
    return gd.banned_text(rows.select(F.to_json(F.struct(*rows.columns)).alias("doc")), "doc")


@query("public_document")
def public_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the published document, read back from its file."""
    panel = stored(dt.document_panel(spark, sf_dir), "panel")
    document = weekly.publish_document(panel, scratch_path(spark, "public"), "2001-01-15")
    return gd.leaves(document).where("role = 'value'").select("path", "text", "number")


def _private(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = stored(dt.document_panel(spark, sf_dir), "panel")
    return weekly.keep_private(panel, dt.charted_names(panel), scratch_path(spark, "private"))


@query("private_document")
def private_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed rows of all captures, read back from the private document."""
    return _private(spark, sf_dir)[0]


@query("private_revision")
def private_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision rows of the private document with lens and chart flag."""
    return _private(spark, sf_dir)[1].select("as_of", "ticker", "rev_rank", "rev_badge", "lens_pass", "chart")


# ---- returns and risk ----------------------------------------------------------------------


def _anchors(bars: DataFrame, captures: DataFrame, feed_end=None) -> DataFrame:
    """Every symbol at every capture date, and at the feed's end where one is given."""
    days = captures.agg(F.collect_set("as_of")).scalar()
    days = F.array_union(days, F.array(feed_end)) if feed_end is not None else days
    return bars.select("symbol").distinct().withColumn("as_of", F.explode(days))


def _forward(spark: SparkSession, sf_dir: str, known: bool) -> DataFrame:
    bars = dt.part_bars(spark, sf_dir)
    feed_end = dt.sessions(spark, sf_dir).agg(F.max("session")).scalar()
    gone = None
    if known:
        gone = bars.groupBy("symbol").agg((F.max("session") < F.to_date(F.lit("2001-03-01"))).alias("delisted"))
    anchors = _anchors(bars, dt.panel_captures(spark, sf_dir), feed_end)
    return _rounded(rt.forward_returns(anchors, bars, feed_end, delisted_known=gone), ret_frac=6)


QUERIES["forward_returns"] = lambda spark, sf_dir: _forward(spark, sf_dir, False)
QUERIES["forward_returns_known"] = lambda spark, sf_dir: _forward(spark, sf_dir, True)


@query("trailing_beta")
def trailing_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = dt.bars(spark, sf_dir)
    anchors = _anchors(bars, dt.panel_captures(spark, sf_dir))
    return _rounded(rt.trailing_risk(anchors, bars, dt.market_bars(spark, sf_dir)), beta=6, drift_per_session=6)


def _adjusted(spark: SparkSession, sf_dir: str, horizons: list[str]) -> DataFrame:
    bars = dt.bars(spark, sf_dir)
    sessions = dt.sessions(spark, sf_dir)
    out = rt.drift_adjusted_returns(
        _anchors(bars, dt.panel_captures(spark, sf_dir)), bars, dt.market_bars(spark, sf_dir), sessions,
        sessions.agg(F.max("session")).scalar(), horizons,
    )
    return _rounded(
        out.select("symbol", "as_of", "horizon", "ret_frac", "market_ret", "n_sessions_held", "alpha"),
        ret_frac=6, market_ret=6, alpha=5,
    )


QUERIES["drift_adjusted"] = lambda spark, sf_dir: _adjusted(spark, sf_dir, ["1m", "3m"])
QUERIES["drift_adjusted_all"] = lambda spark, sf_dir: _adjusted(spark, sf_dir, list(clock.HORIZONS))


@query("business_days_back")
def business_days_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = clock.business_days_back(F.to_date("o_orderdate"), 3)
    return dt.table(spark, sf_dir, "orders").select("o_orderkey", shifted.alias("shifted"))


@query("session_snap")
def session_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dt.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return rt.snap_to_session(orders, "day", dt.sessions(spark, sf_dir)).select("o_orderkey", "snapped")


# ---- graded schemes, portfolios, inference -------------------------------------------------


def graded(name: str, operator: Callable[[DataFrame, DataFrame], DataFrame], **digits: int) -> None:
    """Register an operator over (scheme rows, capture dimension); the rows are built once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        captures = dt.panel_captures(spark, sf_dir)
        rows = stored(sc.scheme_rows(dt.graded_panel(spark, sf_dir, captures)), "rows")
        return _rounded(operator(rows, captures), **digits)

    QUERIES[name] = run


def _last(captures: DataFrame):
    return captures.agg(F.max("capture_ord")).scalar()


def _event_buckets(rows: DataFrame, _: DataFrame) -> DataFrame:
    parts = {"S1a": sc.rating_change(rows), "S1b": sc.target_raise(rows), "S3": sc.gated(rows)}
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(n).alias("scheme"), "as_of", "ticker") for n, df in parts.items()],
    )


def _book(rows: DataFrame, captures: DataFrame) -> DataFrame:
    picks = {"S1a": sc.rating_change(rows), "S1c": sc.score_bucket(rows)}
    members = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("scheme"), "capture_ord", "ticker", "adv_usd") for n, df in picks.items()])
    return pf.cohort_weights(members, _last(captures))


def _books(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Books of all five schemes; the members are stored once, as their counts and their weights read them."""
    members = stored(sc.all_schemes(rows).select("scheme", "capture_ord", "ticker", "adv_usd"), "book-members")
    return stored(pf.cohort_weights(members, _last(captures)), "books")


def _members(rows: DataFrame) -> DataFrame:
    picked = sc.all_schemes(rows).select("scheme", "as_of", "capture_ord", "ticker", "alpha_1w", "alpha_1m", "alpha_3m")
    return stored(picked, "members")


def _series(members: DataFrame) -> DataFrame:
    return members.where("alpha_1m IS NOT NULL").groupBy("scheme", "capture_ord", "as_of").agg(F.avg("alpha_1m").alias("r"))


def _estimates(members: DataFrame) -> DataFrame:
    return inf.estimates(members, {h: F.col(f"alpha_{h}") for h in ("1w", "1m", "3m")})


def _null(rows: DataFrame, members: DataFrame) -> DataFrame:
    return inf.random_entry_null(rows, members, "beta", "alpha_1m")


def _verdicts(rows: DataFrame, captures: DataFrame) -> DataFrame:
    members = _members(rows)
    n = captures.agg(F.count(F.lit(1))).scalar()
    out = inf.verdicts(
        inf.block_bootstrap_ci(inf.block_sums(members, "alpha_1m")),
        inf.bh_fdr(_null(rows, members)),
        inf.sign_stability(_estimates(members)),
        inf.deflated_sharpe(_series(members)),
        captures=n,
        cohorts=n,
    )
    return out.drop("ci_low", "ci_high")


def _regrade(rows: DataFrame, captures: DataFrame) -> DataFrame:
    year_end = F.to_date(F.date_trunc("year", F.col("as_of")) + F.expr("INTERVAL 1 YEAR"))
    return inf.regrade(_series(_members(rows)), captures.select(year_end.alias("cutoff")).distinct())


def _regrade_quarters(rows: DataFrame, captures: DataFrame) -> DataFrame:
    quarter_end = F.to_date(F.date_trunc("quarter", F.col("as_of")) + F.expr("INTERVAL 3 MONTHS")) - F.expr("INTERVAL 1 DAY")
    return inf.regrade(_series(_members(rows)), captures.select(quarter_end.cast("date").alias("cutoff")).distinct())


def _axes(rows: DataFrame, _: DataFrame) -> DataFrame:
    rank = sg.label_rank(F.col("analyst_consensus"))
    news = F.col("news_sentiment")
    return pf.axis_attribution(
        rows,
        {
            "analyst": F.when(rank <= 1, 1).when(rank >= 3, -1).when(rank.isNotNull(), 0),
            "insider": F.when(F.col("insider_signal") == "Positive", 1).when(F.col("insider_signal") == "Negative", -1),
            "news": F.when(news == "Bullish", 1).when(news == "Bearish", -1).when(news.isNotNull(), 0),
        },
        "alpha_1m",
    )


_UP = "best_analyst_upside_pct"
graded("event_buckets", _event_buckets)
graded("target_revision_rank", lambda r, c: sc.with_rank(sc.target_raise(r), "target_pct").select("as_of", "ticker", "target_pct", "place"))
graded("score_class_bucket", lambda r, c: sc.score_bucket(r).select("as_of", "ticker", "smart_score"))
graded(
    "winsor_zscore",
    lambda r, c: sc.winsor_zscores(r, sc.composite_components()).select("as_of", "ticker", "rating_z", "target_z", "insider_z"),
    rating_z=6, target_z=6, insider_z=6,
)
graded(
    "style_residual",
    lambda r, c: sc.style_residual(r, "alpha_1m").where("residual IS NOT NULL").select("as_of", "ticker", "residual"),
    residual=6,
)
graded(
    "composite_decile",
    lambda r, c: sc.top_share(sc.composite(r), "composite_residual").select("as_of", "ticker", "composite_residual"),
    composite_residual=6,
)
graded("capped_top20", lambda r, c: pf.capped_top(r, _UP).select("as_of", "place", "ticker", "sector", F.col(_UP).alias("best_upside")))
graded("cohort_weights", lambda r, c: _book(r, c).drop("adv_usd"), weight=9)
graded(
    "tiered_costs",
    lambda r, c: pf.costs(pf.trades(_book(r, c), _last(c))),
    turnover=6, tiered_bps=6, flat_0_bps=6, flat_5_bps=6, flat_10_bps=6, flat_20_bps=6,
)
graded("book_performance", lambda r, c: pf.book_returns(_book(r, c), r, "alpha_1m"), mean=7, hit_rate=6)
graded(
    "retention_band",
    lambda r, c: pf.retention_band(sc.rank_share(r, _UP)).select("ticker", "capture_ord", "rank_share", "held"),
    rank_share=9,
)
graded("scheme_estimates", lambda r, c: _estimates(_members(r)), mean=7, hit_rate=6)
graded("sign_stability", lambda r, c: inf.sign_stability(_estimates(_members(r))), mean_1w=7, mean_1m=7, mean_3m=7)
graded("block_bootstrap_ci", lambda r, c: inf.block_bootstrap_ci(inf.block_sums(_members(r), "alpha_1m")), mean=7, ci_low=7, ci_high=7)
graded("random_entry_null", lambda r, c: _null(r, _members(r)), actual=7, null_mean=7, p_value=6)
graded(
    "bh_fdr",
    lambda r, c: inf.bh_fdr(_null(r, _members(r))).select("scheme", "p_value", "p_rank", "threshold", "keep"),
    p_value=6, threshold=6,
)
graded("deflated_sharpe", lambda r, c: inf.deflated_sharpe(_series(_members(r))), sharpe=6, sharpe_floor=6, dsr=5)
graded("effective_trials", lambda r, c: inf.effective_trials(_series(_members(r))), mean_rho=6, effective_n=6)
graded("verdicts", _verdicts, mean=7, dsr=5)
graded("quarterly_regrade", _regrade, mean=7)
graded("quarterly_regrade_all", _regrade_quarters, mean=7)
graded("paper_track", lambda r, c: inf.paper_track(_series(_members(r))), net_alpha=7)
graded(
    "decile_diagnostics",
    lambda r, c: pf.diagnostics(sc.rank_share(r, _UP), "rank_share", "alpha_1m"),
    top_mean=7, bottom_mean=7, spread=7, universe_mean=7,
)
graded("score_risers", lambda r, c: pf.score_risers(r, "alpha_1m"), mean=7)
graded("axis_attribution", _axes, positive_mean=7, negative_mean=7)


# ---- streaming -----------------------------------------------------------------------------

_LOGGED = ["ticker", "cap_ts", "analyst_consensus", "best_analyst_price_target", "rating_date"]
_LABEL, _TARGET = "analyst_consensus", "best_analyst_price_target"


def _revision_measures() -> dict[str, Column]:
    direction = sg.label_direction(F.col(f"p.{_LABEL}"), F.col(_LABEL))
    move = sg.target_move(F.col(f"p.{_TARGET}"), F.col(_TARGET))
    return {
        "paired": F.count(F.lit(1)), "upgrades": F.count_if(direction > 0), "downgrades": F.count_if(direction < 0),
        "raises": F.count_if(move > 0), "cuts": F.count_if(move < 0),
    }


def _flow_measures() -> dict[str, Column]:
    day = lambda c: F.to_date(clock.singapore_to_eastern(F.col(c)))
    pct = ev.target_percent(F.col(f"p.{_TARGET}"), F.col(_TARGET))
    moved = ev.past_floor(pct)
    return {
        "paired": F.count(pct), "moves": F.count_if(moved), "raises": F.count_if(moved & (pct > 0)), "cuts": F.count_if(moved & (pct <= 0)),
        "dated": F.count_if(moved & sg.within(F.col("rating_date"), day("p.cap_ts"), day("cap_ts"))),
    }


def _merged_log(spark: SparkSession, log: DataFrame, arrivals: list[Column], measures: dict[str, Column], twice: bool = False):
    """The log fed to a LogMerge in several arrivals, each run to its end; with `twice` every batch is merged again, as after a failure."""
    root = scratch_path(spark, "stream")
    held = mg.LogMerge(f"{root}/merged", "ticker", "cap_ts", (_LABEL, _TARGET), measures, compact_every=2)
    for arrival in arrivals:
        log.where(arrival).select(*_LOGGED).write.mode("append").parquet(f"{root}/log")
        stream = stc.capture_stream(spark, f"{root}/log", log.select(*_LOGGED).schema)
        merge = held.sink(stream)

        def sink(batch: DataFrame, batch_id: int) -> None:
            for _ in range(2 if twice else 1):
                merge(batch, batch_id)

        stc.run_available(stream, sink, f"{root}/state")
    return held, log.select(*_LOGGED).schema


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    captures = dt.event_instants(spark, sf_dir)
    log = stored(dt.event_log(spark, sf_dir, captures).select("capture_ord", *_LOGGED), "log")
    half = F.col("capture_ord") <= captures.agg(F.floor(F.max("capture_ord") / 2)).scalar()
    return log, half, ~half


@query("stream_revision")
def stream_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves per window as the merges of the streamed capture log add them up, fed in two arrivals."""
    log, early, later = _arrivals(spark, sf_dir)
    held, schema = _merged_log(spark, log, [early, later], _revision_measures())
    return held.window_rows(spark, schema).where("paired > 0").select("w", *_revision_measures())


@query("stream_windows")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target flow per window from the stream, every batch merged twice; equals the batch query."""
    log, early, later = _arrivals(spark, sf_dir)
    held, schema = _merged_log(spark, log, [early, later], _flow_measures(), twice=True)
    return held.window_rows(spark, schema).select(
        "w", "kind", "hours", "paired", "moves", "raises", "cuts",
        F.round(F.try_divide(F.col("dated"), F.col("moves")), 4).alias("dated_share"))


@query("stream_late")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side table of rejected records: the early holds and the whole second capture arrive last, the newest capture arrives again."""
    log, early, later = _arrivals(spark, sf_dir)
    log = log.withColumn("_newest", F.col("capture_ord") == log.agg(F.max("capture_ord")).scalar())
    last = early & (F.coalesce(F.col(_LABEL) == "Hold", F.lit(False)) | (F.col("capture_ord") == 1))
    held, schema = _merged_log(spark, log, [early & ~last, later, last | F.col("_newest")], _revision_measures())
    return held.rejected(spark, schema).select("ticker", F.date_format("cap_ts", "yyyy-MM-dd HH:mm:ss").alias("captured"), "reason")


@query("stream_distinct_captures")
def stream_distinct_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints kept by the streaming duplicate filter over the event payloads."""
    root = scratch_path(spark, "dedupe")
    events = dt.table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    headers = source.select(F.sha2("props", 256).alias("sha256"), F.col("ts").cast("timestamp").alias("captured_at"))
    kept = stc.distinct_captures(headers, "sha256", "captured_at", "3650 days")
    stc.run_available(kept, stc.batch_writer(f"{root}/out"), f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("sha256")


# ---- reports over the families above -------------------------------------------------------

on_panel("latest_capture", lambda p: cs.nth_latest(p, 1).select("as_of", "ticker", "liquid"))
on_panel("previous_capture", lambda p: cs.nth_latest(p, 2).select("as_of", "ticker", "liquid"))
on_panel(
    "revision_with_lens",
    lambda p: rv.with_lens(rv.revision_rows(p), p).select("as_of", "ticker", "rev_rank", "lens_pass", "upside_per_vol"),
)
on_log("identity_examples", lambda log, caps: idn.examples(idn.classify(log, caps), 12).select("ticker", "moves"))
QUERIES["leak_offenders"] = lambda spark, sf_dir: gd.offenders(leak_scan(spark, sf_dir))


def _net_of(book: DataFrame, rows: DataFrame, captures: DataFrame) -> DataFrame:
    return pf.net_returns(pf.book_returns(book, rows, "alpha_1m"), pf.costs(pf.trades(book, _last(captures))))


graded("book_net_alpha", lambda r, c: _net_of(stored(_book(r, c), "book"), r, c), gross=7, cost_bps=6, net=7)

# the same for the books of all five schemes
graded("cohort_weights_all", lambda r, c: _books(r, c).drop("adv_usd"), weight=9)
graded(
    "tiered_costs_all",
    lambda r, c: pf.costs(pf.trades(_books(r, c), _last(c))),
    turnover=6, tiered_bps=6, flat_0_bps=6, flat_5_bps=6, flat_10_bps=6, flat_20_bps=6,
)
graded("book_performance_all", lambda r, c: pf.book_returns(_books(r, c), r, "alpha_1m"), mean=7, hit_rate=6)
graded("book_net_alpha_all", lambda r, c: _net_of(_books(r, c), r, c), gross=7, cost_bps=6, net=7)


# ---- grading on realised returns -----------------------------------------------------------


def _realised(spark: SparkSession, sf_dir: str, captures: DataFrame) -> DataFrame:
    bars, market = dt.feed(spark, sf_dir)
    feed_end = market.agg(F.max("session")).scalar()
    return rt.graded_returns(_anchors(bars, captures), bars, market, feed_end)


@query("graded_returns")
def graded_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _realised(spark, sf_dir, dt.panel_captures(spark, sf_dir))
    return _rounded(rows, beta=6, drift_per_session=6, alpha_1w=5, alpha_1m=5, alpha_3m=5)


def realised(name: str, operator: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], **digits: int) -> None:
    """Register an operator over (rows with realised and style-neutral alphas, retained members, captures)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        captures = dt.panel_captures(spark, sf_dir)
        # moves are found while the panel still lies by name; a row per symbol and capture is attached to the liquid rows
        liquid = sc.scheme_rows(dt.ratings_panel(spark, sf_dir, captures)).withColumn("symbol", dt.panel_symbol(F.col("ticker")))
        priced = attach(liquid, _realised(spark, sf_dir, captures), ["symbol", "as_of"])
        rows = stored(gr.neutral_alphas(stored(priced, "priced")), "neutral")
        # every scheme was registered on the day of the first capture and is graded on later ones
        picked = gr.retained_members(rows)
        registered = captures.agg(F.min("as_of").alias("registered_on")).withColumn("scheme", F.explode(F.array(*[F.lit(x) for x in gr.SCHEMES])))
        members = stored(sc.after_registration(picked, registered), "retained")
        return _rounded(operator(rows, members, captures), **digits)

    QUERIES[name] = run


def _quarter_ends(captures: DataFrame) -> DataFrame:
    end = F.to_date(F.date_trunc("quarter", F.col("as_of")) + F.expr("INTERVAL 3 MONTHS")) - F.expr("INTERVAL 1 DAY")
    return captures.select(end.cast("date").alias("cutoff")).distinct()


def _last_cut(captures: DataFrame) -> DataFrame:
    return _quarter_ends(captures).agg(F.max("cutoff").alias("cutoff"))


def _net(rows: DataFrame, members: DataFrame, captures: DataFrame) -> DataFrame:
    return stored(gr.net_series(members, gr.book_costs(members, rows, _last(captures))), "net-series")


realised("retained_book_costs", lambda r, m, c: gr.book_costs(m, r, _last(c)),
         turnover=6, tiered_bps=6, flat_0_bps=6, flat_5_bps=6, flat_10_bps=6, flat_20_bps=6)
realised("retained_top20", lambda r, m, c: gr.retained_top(r, _UP).select("as_of", "ticker", "place", "sector"))
realised("graded_net_alpha", _net, gross=7, gross_1w=7, gross_3m=7, cost_bps=6, net=7)
realised("block_bootstrap_net", lambda r, m, c: gr.bootstrap(gr.graded(_net(r, m, c)), _last_cut(c)), mean=7, ci_low=7, ci_high=7)
realised("drift_matched_null", lambda r, m, c: gr.null_tests(*gr.null_states(r, m), _last_cut(c)), actual=7, null_mean=7, p_value=6)
realised("quarterly_verdicts", lambda r, m, c: gr.verdicts(_net(r, m, c), *gr.null_states(r, m), c, _quarter_ends(c)),
         mean=7, ci_low=7, ci_high=7, p_value=6, dsr=5)
