"""Exact order statistics over groups of any size.

A window over a whole cross-section would put one capture or sector into one task. Here equal
values are counted first (map-side combined), every value falls into a monotone bucket, bucket
totals give each bucket its offset, and only one bucket of one group is ever ordered in a task.
A bucket is 1/64 of a power of two wide, so a group has at most some 10^5 buckets however many
rows it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 64
_SHIFT = 80_000


def value_bucket(v: Column) -> Column:
    """Integer that never decreases as the number grows."""
    x = v.cast("double")
    depth = (F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0)))) * _STEPS) + _SHIFT).cast("int")
    return F.when(x > 0, depth).when(x < 0, -depth).otherwise(0)


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, only: Column | None = None) -> DataFrame:
    """Distinct non-null values per group with `n_equal`, `n_below` and the group's `n_total`.

    `only`, over (`_before`, `_bucket_n`, `n_total`), keeps just the buckets the caller needs.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .withColumn("_bucket", value_bucket(F.col(value)))
        .groupBy(*keys, "_bucket", value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    group = Window.partitionBy(*keys)
    buckets = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("n_equal").alias("_bucket_n"))
        .withColumn("n_total", F.sum("_bucket_n").over(group))
        .withColumn(
            "_before",
            F.sum("_bucket_n").over(
                group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
            )
            - F.col("_bucket_n"),
        )
    )
    if only is not None:
        buckets = buckets.where(only)
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counts.join(buckets, [*keys, "_bucket"])
        .withColumn("n_below", F.col("_before") + F.sum("n_equal").over(inside) - F.col("n_equal"))
        .select(*keys, value, "n_equal", "n_below", "n_total")
    )


def _long(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(n).alias("_name"), c.cast("double").alias("_v")) for n, c in columns.items()]
    )
    return df.select(*keys, F.inline(cells)).where(F.col("_v").isNotNull())


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    probabilities: Sequence[float],
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group and column name.

    Columns: keys, `_name`, and `q0`, `q1`, ... in the order of `probabilities`.
    """
    by = [*keys, "_name"]
    span = F.col("n_total") - 1
    hits = F.lit(False)
    for p in probabilities:
        for end in (F.floor(span * F.lit(p)), F.ceil(span * F.lit(p))):
            hits = hits | ((F.col("_before") <= end) & (end < F.col("_before") + F.col("_bucket_n")))
    ranked = ranked_values(_long(df, keys, columns), by, "_v", hits)
    out = []
    for i, p in enumerate(probabilities):
        position = span * F.lit(p)
        at = lambda r: F.max(
            F.when((F.col("n_below") <= r) & (r < F.col("n_below") + F.col("n_equal")), F.col("_v"))
        )
        low, high = at(F.floor(position)), at(F.ceil(position))
        weight = F.max(position - F.floor(position))
        out.append((low + (high - low) * weight).alias(f"q{i}"))
    return ranked.groupBy(*by).agg(*out)


def medians(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """One row per group holding the exact median of every named column."""
    q = quantiles(df, keys, columns, [0.5])
    pick = [F.max(F.when(F.col("_name") == n, F.col("q0"))).alias(n) for n in columns]
    return q.groupBy(*keys).agg(*pick)


def scattered_index(df: DataFrame, keys: Sequence[str], ident: str, index: str = "idx") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the order of md5(ident).

    The first three hex digits split a group into 4,096 even slices; slice counts give the
    offsets, so no task orders more than one slice.
    """
    keys = list(keys)
    tagged = df.withColumn("_h", F.md5(F.col(ident).cast("string"))).withColumn(
        "_slice", F.substring("_h", 1, 3)
    )
    sizes = tagged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    offsets = sizes.withColumn(
        "_offset",
        F.sum("_n").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
    ).withColumn("group_n", F.sum("_n").over(group))
    rn = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_h"))
    return (
        tagged.withColumn("_rn", rn)
        .join(offsets, [*keys, "_slice"])
        .withColumn(index, F.col("_offset") + F.col("_rn") - 1)
        .drop("_h", "_slice", "_n", "_offset", "_rn")
    )
