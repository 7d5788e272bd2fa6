"""Bounded labelled samples that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `bound` labelled rows outside the held-out fold: id, text, y.

    The rows are those whose ids have the smallest hashes. Labels are reduced to ids first, so their
    broadcast has at most `bound` rows and the texts are not shuffled. Null labels and ids do not count;
    of several labels of one id the largest counts, and of several texts of one id the smallest, so the bound
    holds however often ids repeat.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .filter(remainder(F.col(id_col), folds) != held_out)
        .groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label)).cast("int").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("_lid"), "_lid").limit(bound)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = rows.join(F.broadcast(chosen), F.col("id") == F.col("_lid"))
    return met.groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")
