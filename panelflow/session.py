"""Session settings and the two ways a plan may cut lineage or share a small table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on. AQE carries skew splitting and partition coalescing.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Rows a settled aggregate may hold and still be broadcast (a few tens of MB of narrow rows).
BROADCAST_ROWS = 200_000
# The same for tables of one integer key (some 60 MB in the driver).
BROADCAST_KEYS = 1_000_000


def build(master: str | None = None, app: str = "panelflow", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may leave the setting out.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{spark.conf.get('spark.local.dir', '/tmp')}/panelflow-{sc.applicationId}"
        if named not in _own:
            _own.append(named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def release(spark: SparkSession) -> None:
    """Remove the folders this process made for itself; a folder the cluster names is left alone."""
    jvm = spark.sparkContext._jvm
    while _own:
        path = jvm.org.apache.hadoop.fs.Path(_own.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/panelflow-{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise a small reduced table once, reliably, so that it can be counted and reused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a row-level table to the shared folder and read it back.

    For tables several later steps read: the scan prunes columns and equal exchanges are reused,
    which a checkpointed row set does not offer. Losing executors costs no recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_table(keys: DataFrame, label: str) -> DataFrame:
    """Distinct integer keys, stored and counted, for a join that keeps or drops rows by them.

    Up to BROADCAST_KEYS are broadcast, so that long rows are not shuffled to meet a few keys.
    """
    ready = stored(keys, label)
    return F.broadcast(ready) if ready.count() <= BROADCAST_KEYS else ready


def attach(big: DataFrame, stats: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join per-group statistics back to rows without shuffling rows on a skewed group key.

    `stats` is settled and counted first: small ones are broadcast, larger ones fall back to
    a shuffled join whose hot partitions AQE splits.
    """
    ready = settle(stats)
    if ready.count() <= BROADCAST_ROWS:
        ready = F.broadcast(ready)
    return big.join(ready, on, how)


def attach_per_capture(big: DataFrame, stats: DataFrame, on: str = "as_of", how: str = "left") -> DataFrame:
    """As `attach`, for tables keyed by a DATE alone.

    One row per calendar day at most, so the size is bounded by the DATE key (36,525 rows a
    century) and the broadcast needs no count.
    """
    return big.join(F.broadcast(stats), on, how)
