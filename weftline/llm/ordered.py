"""Positions of rows in a total order, from one range shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import persist_state

_ROW_BITS = 33  # of monotonically_increasing_id: the rows of a partition


def positions(df: DataFrame, group: str, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``pos`` (0, 1, 2, ... in ``order`` inside each group) and ``members`` (rows of the group).

    Rows are range partitioned by (group, order), so a group of any size is spread over many
    tasks, and sorted inside their range. Where a group starts and how many of its rows lie in
    earlier ranges follows from one small row per (range, group). NULL is a group of its own.
    Rows equal in group and order get different positions; they are spread by their place in
    the input, so a table of repeated rows doesn't end in one range either. ``df`` is read
    twice (ranges are sampled) and should be a stored table.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranged = (
        df.withColumn("_place", place)
        .repartitionByRange(n, F.col(group).asc_nulls_first(), *order, F.col("_place"))
        .sortWithinPartitions(F.col(group).asc_nulls_first(), *order, F.col("_place"))
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_id", _ROW_BITS))
        .drop("_place")
    )
    ranged = persist_state(ranged, "ordered")
    counts = persist_state(
        ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")), "ranges"
    )
    keyed = Window.partitionBy(group)
    before = keyed.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"),
        F.col("_range").alias("_r"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(keyed).alias("members"),
    )
    same = (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g"))
    return (
        ranged.join(offsets, same)
        .withColumn("pos", F.col("_id") + F.col("_shift"))
        .select(*df.columns, "pos", "members")
    )
