"""Streaming and incremental work.

The streaming jobs call the same operators as the batch plans. Restart safety comes from the
checkpoint of the query and the file sink's commit log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.functions.columns import share_pct
from weftline.functions.ranking import ORDERED_ROWS, gap_ranges, in_ranges, number_up
from weftline.operators.clean import validate_generated
from weftline.operators.emissions import FactorTable, ModeTable, product_footprint
from weftline.session import persist_state
from weftline.sources.products import parse_generated_lines


def append_available(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to a Parquet table, exactly once, then stop."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(spark: SparkSession, source: str, validate: bool = True) -> DataFrame:
    """New raw text files -> parsed and validated product rows."""
    rows = parse_generated_lines(spark.readStream.text(source))
    return validate_generated(rows) if validate else rows


def footprint_stream(
    spark: SparkSession, source: str, schema: StructType, factors: FactorTable, modes: ModeTable
) -> DataFrame:
    """Footprints of arriving products: a stateless projection with the factors as literals.

    For the few hundred names that fit into a projection; :func:`footprint_sink` takes any
    number.
    """
    return product_footprint(spark.readStream.schema(schema).parquet(source), factors, modes)


def footprint_sink(
    spark: SparkSession,
    source: str,
    schema: StructType,
    factors: FactorTable,
    modes: ModeTable,
    sink: str,
    checkpoint: str,
) -> StreamingQuery:
    """Footprints of everything that has arrived, batch by batch with the batch operator, then stop.

    Factor tables of any size are joined and never collected. A batch writes the folder
    ``batch=<id>`` and replaces it when it is run again, so a restart repeats no row. Files
    never change their batch: the checkpoint holds which file belongs to which.
    """

    def write(batch: DataFrame, number: int) -> None:
        product_footprint(batch, factors, modes).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rolling_error(
    log: DataFrame,
    ts: str = "ts",
    target: str = "target",
    actual: str = "actual",
    predicted: str = "predicted",
    size: str = "6 hours",
    slide: str = "2 hours",
    delay: str = "1 hour",
) -> DataFrame:
    """Rolling mean absolute error per target; rows later than the watermark are dropped.

    Works on a stream and, where the watermark has no effect, on a table.
    """
    return (
        log.withWatermark(ts, delay)
        .groupBy(F.window(ts, size, slide), target)
        .agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"), F.count(F.lit(1)).alias("n"))
        .select("window", target, "mae", "n")
    )


def pending_chunks(
    planned: DataFrame, done: DataFrame, chunk_size: int, category: str = "category_index", rows: str = "n"
) -> DataFrame:
    """(category, chunk, rows in it) still to produce; the last chunk of a category is smaller.

    ``planned`` has one row per category, ``done`` one per finished (category, chunk).
    """
    chunks = number_up(planned.select(category, rows), F.ceil(F.col(rows) / F.lit(chunk_size)), "chunk_index")
    finished = done.select(category, F.col("chunk_index").cast("bigint").alias("chunk_index")).distinct()
    left = chunks.join(finished, [category, "chunk_index"], "left_anti")
    size = F.least(F.lit(chunk_size).cast("bigint"), F.col(rows) - F.col("chunk_index") * chunk_size)
    return left.select(category, "chunk_index", size.alias("rows_in_chunk"))


def progress_summary(
    planned: DataFrame, done: DataFrame, chunk_size: int, category: str = "category_index", rows: str = "n"
) -> DataFrame:
    """Planned, finished and pending chunks and rows, in one row."""
    chunks = planned.agg(
        F.sum(F.ceil(F.col(rows) / F.lit(chunk_size))).alias("planned_chunks"), F.sum(rows).alias("planned_rows")
    )
    left = pending_chunks(planned, done, chunk_size, category, rows).agg(
        F.count(F.lit(1)).alias("pending_chunks"), F.coalesce(F.sum("rows_in_chunk"), F.lit(0)).alias("pending_rows")
    )
    both = chunks.unionByName(left, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("planned_chunks", "planned_rows", "pending_chunks", "pending_rows")]
    )
    finished = F.col("planned_chunks") - F.col("pending_chunks")
    return both.withColumns(
        {"finished_chunks": finished, "pct_finished": share_pct(finished, F.col("planned_chunks"))}
    )


def drift_ks(
    recent: DataFrame, baseline: DataFrame, value: str, by: str, ordered_rows: int = ORDERED_ROWS
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group, exact; NULL and NaN don't count.

    Branch and bound: counts per bin give the gap at the end of every bin and the most that
    it can be inside. Only bins that could exceed the best gap found are cut or, with at most
    ``ordered_rows`` rows, ordered; most values are never shuffled. NULL when a side has no rows.
    """
    number = F.col(value).cast("double") + F.lit(0.0)
    both = recent.select(by, number.alias("_value"), F.lit(1).alias("_r")).unionByName(
        baseline.select(by, number.alias("_value"), F.lit(0).alias("_r"))
    )
    rows = persist_state(both.where(F.col("_value").isNotNull() & ~F.isnan("_value")), "values")
    best, ranges = gap_ranges(rows, by, ordered_rows)
    upto = W.partitionBy(by, "_bin0", "_lo").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = (
        in_ranges(rows, ranges, [by])
        .groupBy(F.col(f"r.{by}").alias(by), "a._bin0", "a._lo", "a._r0", "a._b0", "a._rows_r", "a._rows_b", "r._value")
        .agg(F.sum("r._r").alias("_x"), F.sum(1 - F.col("r._r")).alias("_y"))
        .withColumns({"_x": F.col("_r0") + F.sum("_x").over(upto), "_y": F.col("_b0") + F.sum("_y").over(upto)})
        .groupBy(by)
        .agg(F.max(F.abs(F.col("_x") / F.col("_rows_r") - F.col("_y") / F.col("_rows_b"))).alias("_gap"))
    )
    return (
        best.alias("b")
        .join(inside.alias("i"), F.col(f"b.{by}").eqNullSafe(F.col(f"i.{by}")), "left")
        .select(
            F.col(f"b.{by}").alias(by),
            F.when((F.col("_rows_r") > 0) & (F.col("_rows_b") > 0), F.greatest("_best", "_gap")).alias("ks"),
            F.col("_rows_r").alias("n_recent"),
            F.col("_rows_b").alias("n_baseline"),
        )
    )


def drift_flag(ks: DataFrame, coefficient: float = 1.358) -> DataFrame:
    """Drift when the distance exceeds the large-sample bound (1.358 is the 5 % level)."""
    n, m = F.col("n_recent").cast("double"), F.col("n_baseline").cast("double")
    return ks.withColumn("drift", F.coalesce(F.col("ks") > coefficient * F.sqrt((n + m) / (n * m)), F.lit(False)))
