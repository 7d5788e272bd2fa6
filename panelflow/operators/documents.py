"""The documents of a capture: the public one of aggregates alone, and the private one with a row per name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators import crosssection as cs
from panelflow.operators import revision as rv
from panelflow.schema import CONSENSUS_ORDER, MIN_CAPTURES
from panelflow.session import attach_per_capture

# ---- fixed values: field of a displayed row -> column of the panel view --------------------
ROW_FIELDS = {
    "ticker": "ticker",
    "company": "company",
    "sector": "sector",
    "smart_score": "smart_score",
    "consensus": "analyst_consensus",
    "best_consensus": "best_analyst_consensus",
    "upside": "upside",
    "best_upside": "best_upside",
    "tr_3m": "tr_3m",
    "vol_ann": "vol_ann",
    "bvc_gap": "bvc_gap",
    "insider": "insider_signal",
    "hedgefund": "hedgefund_signal",
    "div_yield": "dividend_yield",
    "mktcap_b": "mktcap_b",
    "idx": "idx",
    "most_accurate": "most_accurate_analyst",
    "most_profitable": "most_profitable_analyst",
    "last_rating": "last_rating_date",
    "news": "news_sentiment",
    "investor": "investor_sentiment",
    "upside_per_vol": "upside_per_vol",
    "lens_pass": "lens_pass",
}
CARRIED = [
    "company", "best_analyst_consensus", "hedgefund_signal", "most_accurate_analyst", "most_profitable_analyst", "last_rating_date",
]
SENTIMENT = {"insider": "insider_signal", "hedgefund": "hedgefund_signal", "investor": "investor_sentiment"}


def with_charts(rows: DataFrame, charted: DataFrame) -> DataFrame:
    """Flag `chart` on rows whose name has a price chart.

    Names grow with the panel, so they are dealt out by name and hashed per task; wide rows are not sorted by name for it.
    """
    flags = charted.select("ticker").distinct().withColumn("chart", F.lit(True)).hint("shuffle_hash")
    return rows.join(flags, "ticker", "left").withColumn("chart", F.coalesce("chart", F.lit(False)))


def private_rows(panel: DataFrame, charted: DataFrame) -> DataFrame:
    """The displayed row of every liquid name of every capture: 23 fields, the chart flag and the capture."""
    view = cs.panel_view(panel, carry=CARRIED)
    return with_charts(view.select("as_of", *[F.col(c).alias(name) for name, c in ROW_FIELDS.items()]), charted)


def _counts(rows: DataFrame, label: str, name: str) -> DataFrame:
    """One map label -> n per capture. Labels come from a fixed domain or are categories of one field."""
    pairs = F.collect_list(F.struct(F.col(label).cast("string").alias("label"), F.col("n").alias("n")))
    return rows.groupBy("as_of").agg(F.map_from_entries(F.array_sort(pairs)).alias(name))


def _section(rows: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    return rows.select("as_of", F.struct(*columns).alias(name))


def _sectors(latest: DataFrame) -> DataFrame:
    """Sectors of a capture, largest first, ties by name; as many as the export has sectors."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), "sector", "n", "mean_ss")))
    return cs.sector_summary(latest).groupBy("as_of").agg(F.transform(ordered, lambda s: s.dropFields("_o")).alias("by_sector"))


def _weekly(panel: DataFrame) -> DataFrame:
    """Series of all captures in the row of the last one: one entry per capture, bounded by the calendar."""
    weeks = rv.weekly_series(panel)
    return weeks.agg(F.max("as_of").alias("as_of"), F.array_sort(F.collect_list(F.struct(*weeks.columns))).alias("weekly"))


def public_document(panel: DataFrame, today: str) -> DataFrame:
    """The public document of the latest capture, one nested row without any name of the panel.

    Sections: universe, kpis, smart_score_hist, consensus, by_sector, sentiment, accrual, revision, weekly. A first
    capture has no window: `revision.available` is false and its counts are null. Every section is an aggregate per
    capture, so only rows keyed by a DATE meet here.
    """
    latest = cs.nth_latest(panel)
    doc = _section(cs.index_counts(latest), "universe", "liquid", "sp500", "sp400")
    week = cs.week_aggregates(latest)
    doc = attach_per_capture(doc, _section(week, "kpis", *[c for c in week.columns if c != "as_of"]))
    doc = attach_per_capture(doc, _counts(cs.score_histogram(latest), "bucket", "smart_score_hist"))
    doc = attach_per_capture(doc, _counts(cs.consensus_mix(latest), "label", "consensus"))
    doc = doc.withColumn(  # the fixed order of the labels, which sorting by name would lose
        "consensus", F.map_from_arrays(F.array(*map(F.lit, CONSENSUS_ORDER)), F.array(*[F.col("consensus")[c] for c in CONSENSUS_ORDER])))
    doc = attach_per_capture(doc, _sectors(latest))
    for axis, field in SENTIMENT.items():
        doc = attach_per_capture(doc, _counts(cs.category_counts(latest, field), "category", axis))
    none = F.create_map().cast("map<string,bigint>")
    doc = doc.withColumn("sentiment", F.struct(*[F.coalesce(a, none).alias(a) for a in SENTIMENT])).drop(*SENTIMENT)
    state = cs.accrual(panel.select("as_of").distinct(), today).withColumnRenamed("last_as_of", "as_of")
    doc = attach_per_capture(doc, _section(state, "accrual", "snapshots", F.lit(MIN_CAPTURES).alias("min_snapshots"), "matured"))
    pair = rv.pair_counts(panel)
    counts = [c for c in pair.columns if c != "as_of"]
    doc = attach_per_capture(doc, _section(pair, "_pair", *counts))
    doc = doc.withColumn("revision", F.struct(F.col("_pair").isNotNull().alias("available"), *[F.col(f"_pair.{c}").alias(c) for c in counts]))
    return attach_per_capture(doc.drop("_pair"), _weekly(panel))
