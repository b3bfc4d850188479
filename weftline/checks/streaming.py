"""Queries of the streaming group: every stream is drained and its sink returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.checks.registry import (
    FACTORS,
    SHIPMENTS,
    ctes,
    factor_table,
    footprints,
    in_list,
    mode_table,
    parsed,
    query,
    r,
    rnd,
    rounded,
    with_long,
)
from weftline.checks.sources import raw_lines
from weftline.constants import MATERIALS
from weftline.schema import PRODUCT_COLUMNS, TARGETS
from weftline.session import scratch_path
from weftline.sources.shipments import shipments, table
from weftline.streaming import jobs


def drain(df, purpose):
    """Run the stream over everything available and return its sink as a table."""
    spark = df.sparkSession
    sink = scratch_path(spark, purpose)
    jobs.append_available(df, sink, scratch_path(spark, purpose + "-checkpoint")).awaitTermination()
    return spark.read.schema(df.schema).parquet(sink)


@query(
    "x1_ingest_stream",
    ctes(SHIPMENTS, parsed())
    + f"""SELECT {', '.join(PRODUCT_COLUMNS)} FROM parsed WHERE j IS NOT NULL
 AND len(list_filter(json_keys(j), lambda k: k NOT IN {in_list(MATERIALS + ['polyster_virgin', 'poliamide_6'])})) = 0
 AND weight_kg BETWEEN 0.05::DOUBLE AND 3 AND total_distance_km BETWEEN 100 AND 40000
 AND weight_kg * 10 <> floor(weight_kg * 10) AND total_distance_km % 100 <> 0""",
)
def x1(spark, sf):
    source = scratch_path(spark, "raw-lines")
    raw_lines(spark, sf).write.text(source)
    return drain(jobs.ingest_stream(spark, source), "ingested")


@query(
    "x2_footprint_stream",
    ctes(SHIPMENTS, FACTORS, footprints("shipments"))
    + f"SELECT product_id, {', '.join(f'{r(t)} AS {t}' for t in TARGETS)} FROM fp",
)
def x2(spark, sf):
    source = scratch_path(spark, "arriving")
    products = shipments(spark, sf)
    products.write.parquet(source)
    sink, checkpoint = scratch_path(spark, "footprints"), scratch_path(spark, "footprints-checkpoint")
    tables = (factor_table(spark), mode_table(spark))
    jobs.footprint_sink(spark, source, products.schema, *tables, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select("product_id", *[rnd(t).alias(t) for t in TARGETS])


PLAN = """WITH planned AS (SELECT p_size % 10 AS category_index, count(*) AS n FROM part GROUP BY 1),
chunks AS (SELECT category_index, n, unnest(range(0, CAST(ceil(n / 20.0) AS BIGINT))) AS chunk_index FROM planned),
done AS (SELECT DISTINCT p_size % 8 AS category_index, p_partkey % 4 AS chunk_index FROM part),
pending AS (SELECT category_index, chunk_index, least(20, n - chunk_index * 20) AS rows_in_chunk FROM chunks
 WHERE (category_index, chunk_index) NOT IN (SELECT (category_index, chunk_index) FROM done))
"""


def _plan(spark, sf):
    part = table(spark, sf, "part")
    planned = part.groupBy((F.col("p_size") % 10).alias("category_index")).agg(F.count(F.lit(1)).alias("n"))
    done = part.select((F.col("p_size") % 8).alias("category_index"), (F.col("p_partkey") % 4).alias("chunk_index"))
    return planned, done


@query("x3_pending_chunks", PLAN + "SELECT CAST(category_index AS BIGINT) AS category_index, chunk_index, rows_in_chunk FROM pending")
def x3(spark, sf):
    return with_long(jobs.pending_chunks(*_plan(spark, sf), 20))


@query(
    "x3_progress_summary",
    PLAN
    + f"""SELECT *, planned_chunks - pending_chunks AS finished_chunks,
 {r('(planned_chunks - pending_chunks) * 100.0::DOUBLE / planned_chunks')} AS pct_finished FROM
 (SELECT (SELECT count(*) FROM chunks) AS planned_chunks, (SELECT CAST(sum(n) AS BIGINT) FROM planned) AS planned_rows,
 (SELECT count(*) FROM pending) AS pending_chunks, (SELECT CAST(sum(rows_in_chunk) AS BIGINT) FROM pending) AS pending_rows) t""",
)
def x3_summary(spark, sf):
    return rounded(jobs.progress_summary(*_plan(spark, sf), 20))


def prediction_log(events):
    """Events as a log: the type is the target, the value the actual, ``k`` of the props the prediction."""
    predicted = F.get_json_object("props", "$.k").cast("double")
    epoch = F.lit("1970-01-01").cast(events.schema["ts"].dataType)
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts")))
    return events.select(instant.alias("ts"), F.col("event_type").alias("target"), F.col("value").alias("actual"), predicted.alias("predicted"))


@query(
    "x4_rolling_error",
    f"""WITH log AS (SELECT ts, event_type AS target, value AS actual, json_extract(props, '$.k')::DOUBLE AS predicted,
 epoch_us(ts) // 7200000000 * 7200 AS slot FROM events),
 w AS (SELECT *, slot - unnest([0, 1, 2]) * 7200 AS window_start FROM log)
 SELECT CAST(window_start AS BIGINT) AS window_start, target, {r('avg(abs(actual - predicted))')} AS mae, count(*) AS n FROM w
 WHERE window_start + 21600 <= (SELECT max(epoch_us(ts)) FROM events) / 1000000.0 - 3600 GROUP BY ALL""",
)
def x4(spark, sf):
    """Windows the watermark has closed after the whole log has been read."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    done = drain(jobs.rolling_error(prediction_log(events)), "rolling")
    start = F.unix_seconds("window.start")
    return done.select(start.alias("window_start"), "target", rnd("mae").alias("mae"), "n")


@query(
    "x5_drift_ks",
    f"""WITH e AS (SELECT event_type AS target, value, ts >= TIMESTAMP '2024-01-20 00:00:00' AS recent FROM events),
 c AS (SELECT target, value, count(*) FILTER (WHERE recent) AS rn, count(*) FILTER (WHERE NOT recent) AS bn FROM e GROUP BY target, value),
 f AS (SELECT target, abs(sum(rn) OVER w / sum(rn) OVER (PARTITION BY target) - sum(bn) OVER w / sum(bn) OVER (PARTITION BY target)) AS gap
  FROM c WINDOW w AS (PARTITION BY target ORDER BY value)),
 k AS (SELECT target, max(gap) AS ks FROM f GROUP BY target),
 n AS (SELECT target, count(*) FILTER (WHERE recent) AS n_recent, count(*) FILTER (WHERE NOT recent) AS n_baseline FROM e GROUP BY target)
 SELECT k.target, {r('ks')} AS ks, n_recent, n_baseline,
 CAST(ks > 1.358::DOUBLE * sqrt((n_recent + n_baseline) / (n_recent * n_baseline::DOUBLE)) AS BIGINT) AS drift
 FROM k JOIN n ON k.target = n.target""",
)
def x5(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("target"), "value", "ts")
    cut = F.lit("2024-01-20 00:00:00").cast(events.schema["ts"].dataType)
    ks = jobs.drift_ks(events.where(F.col("ts") >= cut), events.where(F.col("ts") < cut), "value", "target")
    return with_long(rounded(jobs.drift_flag(ks)))
