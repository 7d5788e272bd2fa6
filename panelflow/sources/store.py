"""Frozen snapshot, merged panel and chart tables on a partitioned Parquet store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampType

UNTIMED = "none"  # partition value of a capture without a clock time


COMMITS = StructType([
    StructField("stream", StringType()), StructField("as_of", DateType()), StructField("hhmm", StringType()),
    StructField("version", StringType()), StructField("committed_at", TimestampType()),
])


def _exists(spark: SparkSession, path: str, condition) -> bool:
    try:
        return not spark.read.parquet(path).where(condition).limit(1).isEmpty()
    except Exception as exc:  # noqa: BLE001 - Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return False
        raise


def commits_path(snapshots: str) -> str:
    return f"{snapshots.rstrip('/')}-commits"


def commits(spark: SparkSession, snapshots: str) -> DataFrame:
    """Manifest: every commit of a capture, one small file each; captures exist only through it. Empty where nothing was committed."""
    try:
        return spark.read.schema(COMMITS).option("recursiveFileLookup", True).json(commits_path(snapshots))
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], COMMITS)
        raise


def filed(spark: SparkSession, snapshots: str) -> DataFrame:
    """The committed version of each capture, the newest where one was filed again by force."""
    newest = F.max_by("version", F.struct("committed_at", "version")).alias("version")
    return commits(spark, snapshots).groupBy("stream", "as_of", "hhmm").agg(newest)


def _same(stream: str, as_of: str, hhmm: str):
    return (F.col("stream") == stream) & (F.col("as_of") == F.to_date(F.lit(as_of))) & (F.col("hhmm") == hhmm)


def copies(spark: SparkSession, snapshots: str, stream: str, as_of: str, hhmm: str = "") -> int:
    """Captures filed under a key so far (0 or 1)."""
    return filed(spark, snapshots).where(_same(stream, as_of, hhmm)).count()


def refuse_frozen(spark: SparkSession, path: str, stream: str, as_of: str, hhmm: str = "") -> None:
    """Raise when a capture is already filed under the key."""
    if copies(spark, path, stream, as_of, hhmm):
        raise FileExistsError(f"{stream} capture {as_of} {hhmm} is already frozen")


def _stage(rows: DataFrame, path: str, stream: str, as_of: str, hhmm: str, version: str) -> None:
    """Write rows below a version of their own; nothing reads them before the version is committed."""
    named = {"stream": F.lit(stream), "as_of": F.to_date(F.lit(as_of)), "hhmm": F.lit(hhmm or UNTIMED), "version": F.lit(version)}
    rows.withColumns(named).write.partitionBy(*named).mode("append").parquet(path)


def file_capture(tables: dict[str, DataFrame], stream: str, as_of: str, hhmm: str = "", snapshots: str = "", force: bool = False) -> None:
    """File the tables (path -> rows) of one capture as one act: all are staged, then one manifest entry makes them visible.

    A failure before the entry leaves staged files that no reader sees, and the capture may be filed again; a second
    capture under the key needs `force`. The entry is one file that Spark moves into place whole.
    """
    spark = next(iter(tables.values())).sparkSession
    if not force:
        refuse_frozen(spark, snapshots, stream, as_of, hhmm)
    version = f"v{uuid.uuid4().hex}"
    for path, rows in tables.items():
        _stage(rows, path, stream, as_of, hhmm, version)
    entry = spark.range(1).select(
        F.lit(stream).alias("stream"), F.to_date(F.lit(as_of)).alias("as_of"), F.lit(hhmm).alias("hhmm"),
        F.lit(version).alias("version"), F.current_timestamp().alias("committed_at"))
    entry.coalesce(1).write.json(f"{commits_path(snapshots)}/{version}")


def write_snapshot(records: DataFrame, path: str, stream: str, as_of: str, hhmm: str = "", force: bool = False) -> None:
    """Freeze one capture without a header; a second write needs `force`."""
    file_capture({path: records}, stream, as_of, hhmm, path, force)


def _committed(spark: SparkSession, path: str, snapshots: str) -> DataFrame:
    """Rows of the committed versions; the manifest has one row per capture, so it prunes the partitions read."""
    # partition columns of digits only would be inferred as numbers
    kept = spark.read.parquet(path).schema
    typed = StructType([StructField(f.name, StringType()) if f.name in ("hhmm", "version") else f for f in kept])
    rows = spark.read.schema(typed).parquet(path)
    rows = rows.withColumn("hhmm", F.when(F.col("hhmm") == UNTIMED, "").otherwise(F.lpad("hhmm", 4, "0")))
    return rows.join(filed(spark, snapshots), ["stream", "as_of", "hhmm", "version"], "left_semi").drop("version")


def load_stream(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """Whole stream; order is in the columns (as_of, hhmm), never in file order."""
    return _committed(spark, path, path).where((F.col("stream") == stream) & F.col("ticker").isNotNull())


def header_path(snapshots: str) -> str:
    return f"{snapshots.rstrip('/')}-headers"


def load_headers(spark: SparkSession, snapshots: str) -> DataFrame | None:
    """Headers of the captures filed so far, one row each; None where there is none yet."""
    path = header_path(snapshots)
    return _committed(spark, path, snapshots) if _exists(spark, path, F.lit(True)) else None


def load_snapshot(spark: SparkSession, path: str, stream: str, as_of: str) -> DataFrame:
    """One capture by key; raises when it is missing."""
    rows = load_stream(spark, path, stream).where(F.col("as_of") == F.to_date(F.lit(as_of)))
    if rows.limit(1).isEmpty():
        raise FileNotFoundError(f"no {stream} snapshot for {as_of}")
    return rows


def read_json_captures(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tolerant scan of capture documents: corrupt files are skipped, the rest is kept."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


CORRUPT = "_corrupt_record"


def scan_json_captures(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Capture documents, one per file or per line, in two tables: the readable ones, and the rest as (file, record, sha256).

    Both carry the file they come from. A corrupt document is kept word for word, so nothing that was read is
    lost; `quarantine_counts` sums both up by file.
    """
    typed = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.option("wholetext", multi_line).text(path).where(F.trim("value") != "")
    kept = [c for c in lines.columns if c != "value"]  # partition columns of the folder
    rows = lines.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), *kept, "value",
        F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_r"))
    bad = F.col(f"_r.{CORRUPT}").isNotNull()
    good = rows.where(~bad).select("file", *kept, *[F.col(f"_r.{f}") for f in schema.names])
    return good, rows.where(bad).select("file", *kept, F.col("value").alias("record"), F.sha2("value", 256).alias("sha256"))


def quarantine_counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Readable and quarantined records per file."""
    both = good.select("file", F.lit(0).alias("bad")).unionByName(bad.select("file", F.lit(1).alias("bad")))
    return both.groupBy("file").agg(F.count_if(F.col("bad") == 0).alias("records"), F.count_if(F.col("bad") == 1).alias("quarantined"))


def write_panel(panel: DataFrame, path: str, force: bool = False) -> None:
    """Merged panel, one partition per capture; other captures are left alone."""
    days = panel.select("as_of").distinct()
    if not force:
        try:
            taken = panel.sparkSession.read.parquet(path).select("as_of").distinct()
        except Exception as exc:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
        else:
            if not days.join(taken, "as_of", "left_semi").limit(1).isEmpty():
                raise FileExistsError("capture already merged")
    panel.write.partitionBy("as_of").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_charts(history: DataFrame, path: str) -> None:
    """Chart series by symbol; the whole set is replaced, so no stale symbol stays behind."""
    history.repartition("symbol").write.partitionBy("symbol").option("partitionOverwriteMode", "static").mode(
        "overwrite"
    ).parquet(path)


def write_document(tables: dict[str, DataFrame], path: str) -> None:
    """Nested dashboard document as JSON lines: one line per section row."""
    for name, df in tables.items():
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("value")).write.mode(
            "overwrite"
        ).json(f"{path.rstrip('/')}/section={name}")


def write_nested(document: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, one per row, nulls written out."""
    document.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_rows_by_capture(rows: DataFrame, path: str) -> None:
    """Rows per name as gzipped JSON lines in one folder per capture; other captures of the folder are left alone.

    Every row repeats the names of its fields, which compression takes out again. A file holds what one task has of one
    capture, so files stay small enough to be read whole.
    """
    kept = rows.write.partitionBy("as_of").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
    kept.option("compression", "gzip").mode("overwrite").json(path)


def read_nested(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
