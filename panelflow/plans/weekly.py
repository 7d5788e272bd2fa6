"""The weekly flow: export -> checks -> frozen snapshot -> merged panel -> published aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelflow.functions.cells import rating_date_lenient
from panelflow.operators import crosssection as cs
from panelflow.operators import documents, guards, quality
from panelflow.operators import revision as rv
from panelflow.operators import universe as un
from panelflow.operators.asof import number_captures
from panelflow.schema import MIN_OVERLAP, ROW_TOLERANCE
from panelflow.session import stored
from panelflow.sources import exports, store


def _prior(spark: SparkSession, snapshots: str, as_of: str, hhmm: str, stream: str, fallback: str | None) -> tuple[DataFrame, DataFrame] | None:
    """Header and keys of the newest earlier capture of `stream`, else of `fallback`; None where there is none."""
    filed = store.load_headers(spark, snapshots)
    if filed is None:
        return None
    before = F.struct("as_of", "hhmm") < F.struct(F.to_date(F.lit(as_of)), F.lit(hhmm))
    for name in filter(None, (stream, fallback)):
        key = filed.where((F.col("stream") == name) & before).agg(F.max(F.struct("as_of", "hhmm")).alias("k")).first()["k"]
        if key is not None:
            same = (F.col("as_of") == F.lit(key["as_of"])) & (F.col("hhmm") == key["hhmm"])
            header = filed.where((F.col("stream") == name) & same)
            return header, store.load_stream(spark, snapshots, name).where(same).select("ticker").distinct()
    return None


def examine(
    spark: SparkSession, pages: Sequence[str], as_of: str, snapshots: str, stream: str = "weekly", hhmm: str = "", force: bool = False,
    fallback: str | None = None, today: str | None = None, row_tolerance: float = ROW_TOLERANCE, min_overlap: float = MIN_OVERLAP,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, header and integrity checks of an export, nothing filed.

    The export's headers are held against those of the newest earlier capture of the stream, or of `fallback`, as
    they were filed; copies are counted in the store. A capture filed without a header is not compared with.
    """
    raw = exports.read_pages(spark, pages)
    n_raw = raw.count()
    if not n_raw:
        raise ValueError("the export holds no rows")
    mapping, unmapped = exports.map_headers([c for c in raw.columns if c not in exports.ROW_ORDER])
    # parsed once: the checks and the store read the same records
    records = stored(exports.snapshot(raw, as_of).drop(*exports.ROW_ORDER), "capture")
    prints = exports.fingerprints(spark, exports.page_files(spark, pages))
    listed = lambda c: prints.agg(F.array_sort(F.collect_list(c))).scalar()
    header = stored(exports.capture_header(records, mapping, unmapped).withColumns({
        "n_raw": F.lit(n_raw).cast("long"), "captured_at": F.current_timestamp(), "hhmm": F.lit(hhmm),
        "sha256": listed("sha256"), "files": listed("file")}), "header")

    read = ["as_of", "hhmm", "n_raw", "n_rows", "mapped_fields", "unmapped_columns", "sha256"]
    number = lambda df, n: df.withColumn("capture_ord", F.lit(n))
    heads, members = number(header.select(read), 2), number(records.select("ticker"), 2)
    prior = _prior(spark, snapshots, as_of, hhmm, stream, fallback)
    if prior is not None:
        heads = heads.unionByName(number(prior[0].select(read), 1))
        members = members.unionByName(number(prior[1], 1))
    copies = F.when(F.col("capture_ord") == 2, store.copies(spark, snapshots, stream, as_of, hhmm) + 1).otherwise(1)
    checks = quality.capture_checks(heads.withColumn("copies", copies), members, today, force, row_tolerance, min_overlap)
    return records, header, checks


def capture(
    spark: SparkSession, pages: Sequence[str], as_of: str, snapshots: str, stream: str = "weekly", hhmm: str = "", force: bool = False,
    fallback: str | None = None, today: str | None = None, row_tolerance: float = ROW_TOLERANCE, min_overlap: float = MIN_OVERLAP,
) -> DataFrame:
    """Read, normalise, check and freeze one capture with its header; returns the frozen records.

    Every integrity check runs before anything is filed. A failed check raises and leaves nothing behind; records
    and header are filed as one act, so a crash in between leaves nothing a reader sees.
    """
    if not force:
        store.refuse_frozen(spark, snapshots, stream, as_of, hhmm)
    records, header, checks = examine(spark, pages, as_of, snapshots, stream, hhmm, force, fallback, today, row_tolerance, min_overlap)
    quality.gate(checks)
    store.file_capture({snapshots: records, store.header_path(snapshots): header}, stream, as_of, hhmm, snapshots, force)
    return store.load_snapshot(spark, snapshots, stream, as_of).where(F.col("hhmm") == hhmm)


def merge(snapshot: DataFrame, bars: DataFrame, membership: DataFrame, panels: str, force: bool = False, proof: DataFrame | None = None) -> DataFrame:
    """Join a capture to prices and membership and add it to the panel table.

    `proof` is the row of `quality.feed_gate` for these tables: a failed check stops before anything is written.
    """
    if proof is not None:
        quality.refuse_feed(proof)
    panel = un.merge_panel(snapshot, bars, membership)
    store.write_panel(panel, panels, force)
    return snapshot.sparkSession.read.parquet(panels)


def ordered_panel(panel: DataFrame) -> DataFrame:
    """Panel rows with capture ordinal, neighbouring captures and the parsed rating date."""
    w = Window.orderBy("as_of")
    days = number_captures(panel.select("as_of").distinct(), ["as_of"]).withColumns(
        {"prev_as_of": F.lag("as_of").over(w), "next_as_of": F.lead("as_of").over(w)}
    )
    return panel.join(F.broadcast(days), "as_of").withColumn("rating_date", rating_date_lenient(F.col("last_rating_date")))


def publish(panel: DataFrame, path: str) -> None:
    """Write the public aggregates after the leak guards; nothing is written on a leak."""
    rows = ordered_panel(panel)
    sections = {
        "weekly": rv.weekly_series(rows),
        "revision": rv.pair_counts(rows),
        "breadth": rv.breadth_order(rv.breadth_public(rows)),
        "consensus": cs.consensus_mix(rows),
        "scores": cs.score_histogram(rows),
        "by_sector": cs.sector_order(cs.sector_summary(rows)).drop("pct_buy"),
        "universe": cs.index_counts(rows).select("as_of", "liquid", "sp500", "sp400"),
    }
    keys = panel.select(F.col("ticker").alias("key"))
    banned: list[str] = []
    published = None
    for name, df in sections.items():
        banned += guards.banned_names(df)
        doc = df.select(F.concat_ws("-", F.lit(name), F.monotonically_increasing_id()).alias("row_id"), F.to_json(F.struct(*df.columns)).alias("doc"))
        published = doc if published is None else published.unionByName(doc)
    guards.refuse_leaks(guards.leaked_keys(keys, published, "doc", "row_id"), banned)
    store.write_document(sections, path)


def publish_document(panel: DataFrame, path: str, today: str) -> DataFrame:
    """Write the public document of the latest capture as one nested JSON row; a key or a banned name at any depth stops it first.

    Keys are those of every capture of the panel, as a name that left may not be published either.
    """
    document = stored(documents.public_document(panel, today), "public")
    guards.refuse_document(panel.select(F.col("ticker").alias("key")), document)
    store.write_nested(document, path)
    return store.read_nested(panel.sparkSession, path, document.schema)


def keep_private(panel: DataFrame, charted: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the private document: the displayed rows and the revision rows with their chart flag, a folder per capture each."""
    out = []
    for name, rows in (
        ("table", documents.private_rows(panel, charted)),
        ("revision", documents.with_charts(rv.with_lens(rv.revision_rows(panel), panel), charted)),
    ):
        target = f"{path.rstrip('/')}/{name}"
        store.write_rows_by_capture(rows, target)
        out.append(store.read_nested(panel.sparkSession, target, rows.schema))
    return out[0], out[1]
