"""Row keys, and packed blocks that carry many keyed values in one row of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.session import stored

BLOCK_BYTES = 8 << 20  # text that one block of documents, or one bucket of their hashes, stands for


def plain(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are integers without nulls and repeats."""
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return False
    odd = docs.groupBy(F.col(id_col).alias("id")).count().filter("id IS NULL OR count > 1")
    return odd.isEmpty()


def numbered(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """All columns and a row number under `name` that sorts like the id (nulls last), then the text's hash.

    Sorted once and written to the shared folder, so that the numbers never change.
    """
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col))
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered")


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, bool]:
    """Rows (key long, id, text) whose keys differ and ascend with the ids; the number of blocks; whether key is id.

    Integer ids without nulls and repeats are their own keys; rows of other tables are numbered.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, -(-size // BLOCK_BYTES))
    if plain(rows, "id"):
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text"), blocks, True
    return numbered(rows, "id", "text", "key").select("key", "id", "text"), blocks, False


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between successive cuts, each run as one binary value."""
    raw = np.ascontiguousarray(values)
    offsets = (cuts * raw.itemsize * int(np.prod(raw.shape[1:]))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def unpacked(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All values of a column of packed runs."""
    runs = column.to_pylist()
    return np.frombuffer(b"".join(r for r in runs if r), dtype)


def packed(number: np.ndarray, columns: dict[str, np.ndarray], name: str) -> pa.RecordBatch:
    """One row for each distinct number: the number under `name`, and the values of each column as a run."""
    order = np.argsort(number, kind="stable")
    number = number[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) if len(number) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(number[cuts[:-1]].astype(np.int32)), *(binary(c[order], cuts) for c in columns.values())],
        [name, *columns])


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    from panelflow.llm import words

    return (words.mixed(keys.astype(np.uint64), 3) % np.uint64(blocks)).astype(np.int32)
