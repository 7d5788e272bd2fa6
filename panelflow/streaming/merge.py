"""Capture log as a stream of batch merges: last records, rejects, capture ordinals and window rows in tables.

Everything runs as DataFrame operations inside foreachBatch. A batch reads only what earlier batches wrote and
overwrites its own partitions, so a batch that is run again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions import clock

ORDINAL = "capture_ord"
# ---- fixed values: why a record goes to the side table -------------------------------------
NO_KEY, STALE, NOT_LATER, REPEATED = "no key", "capture not after the last one", "record not after the last one", "repeated in its batch"


@dataclass(frozen=True)
class LogMerge:
    """Tables below `path` that a log keyed by `key` and ordered by `instant` is merged into.

    calendar: capture instants with their ordinals. A capture counts only if it comes after all captures of
    earlier batches; records of a known capture may still arrive in several batches.
    records: accepted records with the accepted record of the key before them as `p` (instant, ordinal,
    `carried`), and apart from them (late=true) the rejected ones with a `reason`.
    last: the last accepted record of each key, as changes per batch; each `compact_every`-th batch writes all of them,
    so a batch reads at most that many change sets.
    windows: sums of `measures` over the records whose `p` lies in the capture just before, per ordinal
    and batch. A window's records may come in several batches; `window_rows` adds them up.

    A key has one record per capture, so the ordered windows per key are bounded by the captures of a
    batch; records without a key or on a stale capture never enter them.
    """

    path: str
    key: str
    instant: str
    carried: tuple[str, ...]
    measures: dict[str, Column]
    compact_every: int = 16

    # ---- tables

    def _schemas(self, log: T.StructType) -> dict[str, T.StructType]:
        field = lambda name: T.StructField(name, log[name].dataType)
        batch, ordinal = T.StructField("batch_id", T.LongType()), T.StructField(ORDINAL, T.IntegerType())
        last = [field(self.instant), ordinal, *map(field, self.carried)]
        return {
            "calendar": T.StructType([field(self.instant), ordinal, batch]),
            "records": T.StructType([
                *[T.StructField(f.name, f.dataType) for f in log.fields], ordinal, T.StructField("p", T.StructType(last)),
                T.StructField("reason", T.StringType()), T.StructField("late", T.BooleanType()), batch,
            ]),
            "last": T.StructType([field(self.key), *last, T.StructField("whole", T.BooleanType()), batch]),
            "windows": T.StructType([
                T.StructField("w", T.IntegerType()), *[T.StructField(m, T.LongType()) for m in self.measures], batch,
            ]),
        }

    def _read(self, spark: SparkSession, name: str, log: T.StructType) -> DataFrame:
        return spark.read.schema(self._schemas(log)[name]).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str, *parts: str) -> None:
        rows.write.partitionBy(*parts).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")

    def prepare(self, spark: SparkSession, log: T.StructType) -> None:
        """Lay the tables down empty where they are missing."""
        for name, schema in self._schemas(log).items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")

    # ---- one batch

    def last_records(self, spark: SparkSession, log: T.StructType, before: int | None = None) -> DataFrame:
        """Last accepted record of each key as the batches before `before` (or all) left it."""
        rows = self._read(spark, "last", log)
        if before is not None:
            rows = rows.where(F.col("batch_id") < before)
        base = rows.where("whole").agg(F.max("batch_id")).first()[0]
        if base is not None:
            rows = rows.where(F.col("batch_id") >= base)
        fields = F.struct(self.instant, ORDINAL, *self.carried)
        return rows.groupBy(self.key).agg(F.max_by(fields, self.instant).alias("_last")).select(self.key, "_last.*")

    def _number(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Ordinals of the captures new in this batch, written; the calendar up to and with this batch."""
        spark, log = batch.sparkSession, batch.schema
        before = self._read(spark, "calendar", log).where(F.col("batch_id") < batch_id)
        at = F.col(self.instant)
        fresh = batch.select(self.instant).distinct().where(at.isNotNull() & F.coalesce(at > before.agg(F.max(self.instant)).scalar(), F.lit(True)))
        start = F.coalesce(before.agg(F.max(ORDINAL) + 1).scalar(), F.lit(0))
        # one row per capture of the batch
        numbered = fresh.withColumn(ORDINAL, (F.row_number().over(Window.orderBy(self.instant)) - 1 + start).cast("int"))
        self._write(numbered.withColumn("batch_id", F.lit(batch_id)), "calendar", "batch_id")
        return self._read(spark, "calendar", log).where(F.col("batch_id") <= batch_id).select(self.instant, ORDINAL)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch sink."""
        spark, log = batch.sparkSession, batch.schema
        if ORDINAL in batch.columns:
            raise ValueError(f"the stream numbers captures itself; rename {ORDINAL}")
        c, key, at = F.col, self.key, self.instant
        placed = batch.join(self._number(batch, batch_id), at, "left").withColumn("_row", F.struct(*batch.columns))
        apart = F.when(c(key).isNull(), NO_KEY).when(c(ORDINAL).isNull(), STALE)
        state = T.StructType([T.StructField(f, log[f].dataType if f in log.names else T.IntegerType()) for f in (at, ORDINAL, *self.carried)])
        none = F.lit(None).cast(state)

        held = self.last_records(spark, log, batch_id).withColumns({"_row": F.lit(None).cast(log), "_held": F.lit(True)})
        fields = [key, at, ORDINAL, *self.carried, "_row", "_held"]
        both = placed.where(apart.isNull()).withColumn("_held", F.lit(False)).select(*fields).unionByName(held.select(*fields))
        of_key = Window.partitionBy(key)
        copy = F.row_number().over(Window.partitionBy(key, at).orderBy(F.desc("_held"), F.xxhash64("_row")))
        tagged = both.withColumn("_last", F.max(F.when(c("_held"), c(at))).over(of_key)).withColumn("_copy", copy)
        reason = F.when(c("_held"), None).when(c(at) <= c("_last"), NOT_LATER).when(c("_copy") > 1, REPEATED)
        tagged = tagged.withColumn("reason", reason)
        # rejected records keep their place in the order but are passed over: the last accepted one before counts
        accepted = F.when(c("reason").isNull(), F.struct(at, ORDINAL, *self.carried))
        before = F.last(accepted, ignorenulls=True).over(of_key.orderBy(at, "_copy").rowsBetween(Window.unboundedPreceding, -1))
        merged = tagged.withColumn("p", F.when(c("reason").isNull(), before)).where(~c("_held"))
        out = merged.select("_row.*", ORDINAL, "p", "reason").unionByName(
            placed.where(apart.isNotNull()).select("_row.*", ORDINAL, none.alias("p"), apart.alias("reason")))
        out = out.withColumns({"late": c("reason").isNotNull(), "batch_id": F.lit(batch_id)})
        self._write(out, "records", "late", "batch_id")

        # what follows reads the batch's own records back instead of merging again
        mine = self._read(spark, "records", log).where((c("batch_id") == batch_id) & ~c("late"))
        moved = mine.groupBy(key).agg(F.max_by(F.struct(at, ORDINAL, *self.carried), at).alias("_last")).select(key, "_last.*")
        whole = batch_id > 0 and batch_id % self.compact_every == 0
        if whole:
            rest = self.last_records(spark, log, batch_id).join(moved.select(key), key, "left_anti")
            moved = moved.unionByName(rest)
        self._write(moved.withColumns({"whole": F.lit(whole), "batch_id": F.lit(batch_id)}), "last", "whole", "batch_id")
        sums = mine.where(c(f"p.{ORDINAL}") == c(ORDINAL) - 1).groupBy(c(ORDINAL).alias("w")).agg(
            *[m.cast("long").alias(n) for n, m in self.measures.items()])
        self._write(sums.withColumn("batch_id", F.lit(batch_id)), "windows", "batch_id")

    def sink(self, stream: DataFrame) -> Callable[[DataFrame, int], None]:
        self.prepare(stream.sparkSession, stream.schema)
        return self.merge

    # ---- results

    def accepted(self, spark: SparkSession, log: T.StructType) -> DataFrame:
        return self._read(spark, "records", log).where("NOT late").drop("reason", "late")

    def rejected(self, spark: SparkSession, log: T.StructType) -> DataFrame:
        """Side table of the records that came too late, with the reason."""
        return self._read(spark, "records", log).where("late").drop("p", "late")

    def window_rows(self, spark: SparkSession, log: T.StructType) -> DataFrame:
        """One row per window (from the capture before to capture `w`) with its ends in US Eastern, its class, hours and sums."""
        days = self._read(spark, "calendar", log).withColumn("b_et", clock.singapore_to_eastern(F.col(self.instant)))
        # the calendar has one row per capture
        spans = days.select(F.col(ORDINAL).alias("w"), F.lag("b_et").over(Window.orderBy(ORDINAL)).alias("a_et"), "b_et").where("a_et IS NOT NULL")
        sums = self._read(spark, "windows", log).groupBy("w").agg(*[F.sum(m).alias(m) for m in self.measures])
        return spans.join(sums, "w", "left").fillna(0, list(self.measures)).withColumns({
            "kind": clock.window_kind(F.col("a_et"), F.col("b_et")),
            "hours": F.round(clock.elapsed_hours(F.col("a_et"), F.col("b_et")), 4),
        })
