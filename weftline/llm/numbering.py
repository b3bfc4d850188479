"""Gapless numbers for rows without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import persist_state


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def number_within(
    df: DataFrame, group: list[str], order: list[Column], name: str, buckets: int = 1024
) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... without gaps inside every group.

    Rows are dealt to ``buckets`` hash buckets of their order values. Bucket counts are
    combined map-side and summed up per group (at most ``buckets`` rows per group); rows are
    ordered only inside a (group, bucket). A group that holds most rows is thus spread over
    all tasks. Groups may be NULL. Equal rows get different numbers.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    on = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    return (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, on)
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .select(*df.columns, name)
    )


def rank_values(df: DataFrame, column: str, name: str, partitions: int = 16) -> DataFrame:
    """Adds ``name``: the position (from 0) of each row by ``column``, NULL last.

    Values are range partitioned and ordered inside their range; the offsets are the row
    counts of the earlier ranges (``partitions`` rows).
    """
    ranged = persist_state(
        df.repartitionByRange(partitions, F.col(column).asc_nulls_last()).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranges",
    )
    parts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offset, total = F.lit(0), 0
    for part in sorted(parts):
        offset = F.when(F.col("_part") == part, F.lit(total)).otherwise(offset)
        total += parts[part]
    inside = Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())
    return ranged.withColumn(name, F.row_number().over(inside) - 1 + offset).select(*df.columns, name)
