"""Exact deduplication: local, salted and global combining, full content compared at every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import stored

# white space that does not count when texts are compared
IGNORED = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised contents are. Of equal texts the row with most code points
    in the original text stays, then the smallest id.

    Digests alone cross the first shuffle, to tell which texts can have a partner at all. The contents
    of those rows are then combined three times, each time grouped by digest *and* content: inside each
    task (map-side combine), per (digest, salt), and over the salts. A text that makes up a third of
    all rows leaves a task as one row and meets its copies in `salts` places first.

    Null text counts as empty; empty texts are equal to each other. A null id sorts last, so it stays
    only if no copy has an id. Rows repeating both id and content count in group_size; one of them
    is kept. An empty table gives an empty table. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    content = rows.select(
        "_id", normalised(F.col("_text")).alias("_norm"),
        F.char_length(F.coalesce("_text", F.lit(""))).cast("long").alias("_cp"),
    ).withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256))
    light = stored(content.select("_id", "_sha", "_cp"), "exact-light")

    repeated = light.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_sha")
    partners = light.join(repeated, "_sha", "left_semi").select(F.col("_id").alias("_pid")).distinct()
    shared = content.join(partners, F.col("_id").eqNullSafe(F.col("_pid")), "left_semi")

    first = F.min(F.struct((-F.col("_cp")).alias("c"), F.col("_id").isNull().alias("u"), F.col("_id").alias("id")))
    salted = (
        shared.withColumn("_salt", F.pmod(F.xxhash64("_id", "_cp"), F.lit(salts)))
        .groupBy("_sha", "_salt", "_norm").agg(first.alias("_best"), F.count(F.lit(1)).alias("_n"))
    )
    whole = salted.groupBy("_sha", "_norm").agg(F.min("_best").alias("_best"), F.sum("_n").alias("_size"))
    same_digest = F.count(F.lit(1)).over(Window.partitionBy("_sha"))
    classes = stored(
        whole.withColumn("_classes", same_digest).select(
            "_sha", F.when(F.col("_classes") > 1, F.col("_norm")).alias("_norm"),
            F.col("_best.id").alias("keep_id"), F.col("_size").alias("group_size"),
        ), "exact-classes",
    )

    # every member of a digest with one class has been compared with it, so the digest names the class
    settled = classes.filter(F.col("_norm").isNull()).drop("_norm").withColumn("_found", F.lit(True))
    collided = classes.filter(F.col("_norm").isNotNull())
    named = light.join(settled, "_sha", "left")
    if not collided.isEmpty():
        apart = content.join(collided, ["_sha", "_norm"]).withColumn("_found", F.lit(True))
        named = named.join(collided.select("_sha").distinct(), "_sha", "left_anti").unionByName(apart.select(named.columns))
    named = named.withColumn("keep_id", F.when(F.col("_found"), F.col("keep_id")).otherwise(F.col("_id")))

    copies = Window.partitionBy("_sha", "_id").orderBy(F.desc("_cp"))
    chosen = F.col("_id").eqNullSafe(F.col("keep_id"))
    return named.withColumn("_rn", F.row_number().over(copies)).select(
        F.col("_id").alias(id_col), "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (chosen & (F.col("_rn") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
