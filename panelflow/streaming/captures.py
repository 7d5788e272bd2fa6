"""Streaming form of the capture log: per-key delta, late and duplicate captures, gaps."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.operators import quality
from panelflow.streaming import last_record

# the state holder travels with the query, so executors need no installed copy of it
cloudpickle.register_pickle_by_value(last_record)

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def capture_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Append-only capture log as a file stream with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_previous(log: DataFrame, key: str, order: str, carried: Sequence[str]) -> DataFrame:
    """Every record with the last earlier record of its key (`p`), across micro-batches.

    A record not strictly later than the key's last one is marked `late` and leaves the state
    alone. The operator only remembers; what counts as a change stays a column expression.
    """
    fields = [order, *carried]
    state = T.StructType([T.StructField(f, log.schema[f].dataType) for f in fields])
    out = T.StructType(
        [
            *[T.StructField(f.name, f.dataType) for f in log.schema.fields],
            T.StructField("p", state),
            T.StructField("late", T.BooleanType()),
        ]
    )
    holder = last_record.LastRecord(log.columns, order, fields, state)
    return log.groupBy(key).transformWithState(
        statefulProcessor=holder, outputStructType=out, outputMode="append", timeMode="none"
    )


def adjacent_only(records: DataFrame, order: str = "capture_ord") -> DataFrame:
    """Records on time whose previous record belongs to the capture just before."""
    return records.where(~F.col("late") & (F.col(f"p.{order}") == F.col(order) - 1))


def distinct_captures(headers: DataFrame, digest: str, ts: str, horizon: str = "30 days") -> DataFrame:
    """Capture headers with a fingerprint not seen within the horizon."""
    return headers.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([digest])


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Use the RocksDB state store while a stateful query is started and run."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one partition per micro-batch, overwritten when a batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.partitionBy("batch_id").option(
            "partitionOverwriteMode", "dynamic"
        ).mode("overwrite").parquet(path)

    return write


def gap_reporter(sessions: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: session coverage of the batch's captures; gaps are reported, not fatal."""

    def report(batch: DataFrame, batch_id: int) -> None:
        covered = quality.session_coverage(batch.select("as_of").distinct(), sessions)
        batch_writer(path)(covered, batch_id)

    return report


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived and stop; the checkpoint carries state to the next run."""
    with rocksdb_state(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

