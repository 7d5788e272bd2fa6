"""Export pages: discovery, header mapping, normalisation, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import cells
from panelflow.schema import HEADER_FRAGMENTS, NUMERIC_FIELDS, record_type

ROW_ORDER = ["_page", "_block", "_row"]


def page_files(spark: SparkSession, paths: Sequence[str], suffix: str = ".csv") -> list[str]:
    """Files in the order given; a directory stands for its sorted pages; repeats are dropped.

    Only file names reach the driver (the listing of the binary source reads no content). Spreadsheets in a
    folder are not read; rather than leave their rows out, it is refused.
    """
    names: list[str] = []
    for p in paths:
        if p.lower().endswith(suffix):
            names.append(p)
            continue
        sheets = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xls,xlsx,xlsm,XLS,XLSX}").load(p).select("path")
        unread = [r.path for r in sheets.orderBy("path").collect()]
        if unread:
            raise ValueError(f"spreadsheet pages cannot be read: {unread}")
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(p)
        names += [r.path for r in found.select("path").orderBy("path").collect()]
    out: dict[str, str] = {}
    for n in names:
        out.setdefault(n.removeprefix("file:").lower(), n)
    if not out:
        raise FileNotFoundError(f"no {suffix} export found in {list(paths)}")
    return list(out.values())


def newest_file(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """Path with the latest modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
        F.max("modificationTime").alias("modified"),
    )


def fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SHA-256 per file, computed where the file is read."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def read_pages(spark: SparkSession, paths: Sequence[str], na_tokens: Sequence[str] = ()) -> DataFrame:
    """All pages as text columns with their row order; all-blank rows are dropped.

    A row's place is (page, byte offset of its file split, running id inside the split), which
    follows the file however Spark schedules the splits. `na_tokens` are read as missing cells.
    """
    pages = []
    for number, path in enumerate(page_files(spark, paths)):
        page = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        blank = F.array(*[F.lit(t) for t in na_tokens]) if na_tokens else None
        names = page.columns
        tidy = [
            (F.when(~F.array_contains(blank, F.col(f"`{c}`")), F.col(f"`{c}`")) if na_tokens else F.col(f"`{c}`")).alias(c)
            for c in names
        ]
        pages.append(
            page.select(
                *tidy,
                F.lit(number).alias("_page"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_row"),
            ).dropna("all", subset=names)
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def map_headers(columns: Sequence[str]) -> tuple[dict[str, str], list[str]]:
    """Assign raw headers to canonical fields; each field once, in header order."""
    free = dict(HEADER_FRAGMENTS)
    mapping: dict[str, str] = {}
    for raw in columns:
        low = raw.strip().lower()
        field = next((f for f, parts in free.items() if any(p in low for p in parts)), None)
        if field is not None:
            mapping[raw] = field
            del free[field]
    return mapping, [c for c in columns if c not in mapping]


def normalise(raw: DataFrame, as_of, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Raw text export to snapshot records: one projection over the whole table.

    `as_of` is a Column or an ISO date. Fields absent from the export are null; rows without a
    key are dropped.
    """
    mapping, _ = map_headers([c for c in raw.columns if c not in order])
    if "ticker" not in mapping.values():
        raise ValueError(f"no ticker or symbol column among {raw.columns}")
    source = {field: F.col(f"`{name}`") for name, field in mapping.items()}
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of

    def cell(field: str):
        if field not in source:
            return F.lit(None).cast(record_type(field))
        if field == "ticker":
            return cells.key_cell(source[field])
        return (cells.numeric_cell if field in NUMERIC_FIELDS else cells.text_cell)(source[field])

    kept = [c for c in order if c in raw.columns]
    return raw.select(
        day.alias("as_of"), *[cell(f).alias(f) for f in HEADER_FRAGMENTS], *kept
    ).where("ticker IS NOT NULL")


def keep_first(records: DataFrame, order: Sequence[str] = ROW_ORDER, key: Sequence[str] = ("as_of", "ticker")) -> DataFrame:
    """First record of a key in row order, with the number of later repeats.

    An aggregate with map-side combine: a key repeated in a third of all rows leaves every task
    as one row.
    """
    rest = [c for c in records.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return records.groupBy(*key).agg(first, (F.count(F.lit(1)) - 1).alias("n_dropped")).select(
        *key, "_first.*", "n_dropped"
    )


def snapshot(raw: DataFrame, as_of, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Raw export to de-duplicated snapshot records.

    Only the key is normalised before the shuffle; cells are parsed afterwards, on the records
    that are kept.
    """
    mapping, _ = map_headers([c for c in raw.columns if c not in order])
    name = next((raw_name for raw_name, field in mapping.items() if field == "ticker"), None)
    if name is None:
        raise ValueError(f"no ticker or symbol column among {raw.columns}")
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    keyed = raw.withColumn("_day", day).withColumn("_key", cells.key_cell(F.col(f"`{name}`"))).where("_key IS NOT NULL")
    first = keep_first(keyed, order, ("_day", "_key"))
    return normalise(first, F.col("_day"), [*order, "_day", "_key", "n_dropped"]).drop("_day", "_key")


def capture_header(records: DataFrame, mapping: dict[str, str], unmapped: Sequence[str]) -> DataFrame:
    """One row per capture: weekday, weekend flag, counts and the header bookkeeping."""
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return records.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_dropped").alias("n_dropped"),
    ).select(
        F.lit(1).alias("schema_version"), "as_of",
        F.date_format("as_of", "EEEE").alias("as_of_weekday"),
        (F.weekday("as_of") >= 5).alias("as_of_is_weekend"),
        "n_rows", "n_dropped",
        texts(mapping.values()).alias("mapped_fields"),
        texts(unmapped).alias("unmapped_columns"),
    )
