"""Queries of the split group."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.checks.registry import (
    SHIPMENTS,
    SHIPMENTS_FP,
    ctes,
    parsed,
    query,
    shares,
    shipments_fp,
    with_long,
)
from weftline.functions.hashing import HASH_SPACE
from weftline.operators import compose, split
from weftline.schema import TARGETS
from weftline.session import persist_state
from weftline.sources.shipments import shipments

PLAIN = ctes(SHIPMENTS)


def hash_sql(key: str, seed) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 15))::BIGINT"


def uniform_sql(key: str, seed) -> str:
    return f"({hash_sql(key, seed)} / {int(HASH_SPACE)}::DOUBLE)"


@query(
    "l1_hash_split",
    PLAIN
    + f"""SELECT product_id, CASE WHEN {uniform_sql('product_id', 42)} < 0.75::DOUBLE THEN 'train' ELSE 'validation' END AS part
 FROM shipments""",
)
def l1(spark, sf):
    return split.hash_split(shipments(spark, sf), "product_id").select("product_id", "part")


@query(
    "l2_exact_split",
    PLAIN
    + f"""SELECT product_id, CASE WHEN row_number() OVER (ORDER BY {hash_sql('product_id', 42)}) <= floor(count(*) OVER () * 0.75::DOUBLE)
 THEN 'train' ELSE 'validation' END AS part FROM shipments""",
)
def l2(spark, sf):
    return split.exact_split(shipments(spark, sf).select("product_id"), "product_id")


STRATA = [
    SHIPMENTS,
    parsed(),
    shares("product_id"),
    "counts AS (SELECT material, count(*) AS n FROM shares GROUP BY material)",
    """strata AS (SELECT p.product_id, CASE WHEN m.n IS NULL OR m.n >= 3450 THEN 'Common' WHEN m.n < 640 THEN 'Other'
 ELSE m.material END AS stratum FROM parsed p LEFT JOIN (SELECT s.product_id, min(c.n) AS n,
 arg_min(s.material, (c.n, s.material)) AS material FROM shares s JOIN counts c ON s.material = c.material GROUP BY s.product_id) m
 ON p.product_id = m.product_id)""",
]


def _strata(spark, sf):
    """Thresholds that leave some materials common, some rare and some too rare at the test size."""
    return split.rarest_material_stratum(shipments(spark, sf), 3450, 640)


@query("l3_rarest_material_stratum", ctes(*STRATA) + "SELECT product_id, stratum FROM strata")
def l3(spark, sf):
    return _strata(spark, sf).select("product_id", "stratum")


RANKED = f"""ranked AS (SELECT product_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {hash_sql('product_id', 42)}) AS rn,
 count(*) OVER (PARTITION BY stratum) AS n FROM strata)"""
PARTS = """parts AS (SELECT product_id, stratum, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
 WHEN rn <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM ranked)"""


@query("l4_stratified_split", ctes(*STRATA, RANKED, PARTS) + "SELECT product_id, stratum, part FROM parts")
def l4(spark, sf):
    return split.stratified_split(_strata(spark, sf).select("product_id", "stratum"), "product_id")


@query(
    "l4_split_coverage",
    ctes(*STRATA, RANKED, PARTS)
    + """SELECT stratum, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'validation') AS n_validation,
 count(*) FILTER (WHERE part = 'test') AS n_test,
 CAST(count(DISTINCT part) = 3 AS BIGINT) AS covered FROM parts GROUP BY stratum""",
)
def l4_coverage(spark, sf):
    return with_long(split.split_coverage(l4(spark, sf)))


@query(
    "l5_trim_outliers",
    SHIPMENTS_FP.rstrip()
    + f""",
 parts AS (SELECT *, CASE WHEN {uniform_sql('product_id', 42)} < 0.75::DOUBLE THEN 'train' ELSE 'validation' END AS part FROM fp),
 t AS (SELECT {', '.join(f'quantile_cont({c}, 0.999) AS q_{c}' for c in TARGETS)} FROM parts WHERE part = 'train')
 SELECT product_id, part FROM parts, t WHERE {' AND '.join(f'{c} >= 0 AND {c} <= q_{c}' for c in TARGETS)}""",
)
def l5(spark, sf):
    stored = persist_state(shipments_fp(spark, sf).select("product_id", *TARGETS), "footprints")
    done = split.hash_split(stored, "product_id")
    train, validation = done.where(F.col("part") == "train"), done.where(F.col("part") == "validation")
    kept = split.trim_outliers(train, validation)
    return kept[0].unionByName(kept[1]).select("product_id", "part")


@query(
    "l6_mask_features",
    ctes(SHIPMENTS, parsed(), shares("product_id"))
    + f"""SELECT p.product_id, CASE WHEN {uniform_sql('p.product_id', '42-weight')} >= 0.15::DOUBLE THEN weight_kg END AS weight_kg,
 CASE WHEN {uniform_sql('p.product_id', '42-distance')} >= 0.25::DOUBLE THEN total_distance_km END AS total_distance_km,
 CASE WHEN {uniform_sql('p.product_id', '42-materials')} < 0.1::DOUBLE THEN 0 ELSE coalesce(s.silk, 0) END AS silk
 FROM shipments p LEFT JOIN (SELECT product_id, max(share) FILTER (WHERE material = 'silk') AS silk FROM shares GROUP BY product_id) s
 ON p.product_id = s.product_id""",
)
def l6(spark, sf):
    wide = compose.pivot_materials(compose.with_composition(shipments(spark, sf)))
    return split.mask_features(wide, "product_id").select("product_id", "weight_kg", "total_distance_km", "silk")


@query(
    "l7_corrupt",
    PLAIN
    + f"""SELECT product_id, CASE WHEN hit AND kind = 0 THEN NULL ELSE weight_kg END AS weight_kg,
 CASE WHEN hit AND kind = 1 THEN NULL ELSE total_distance_km END AS total_distance_km,
 CAST(hit AND kind = 2 AS BIGINT) AS lost_materials FROM
 (SELECT *, row_number() OVER (ORDER BY {hash_sql('product_id', 'corrupt-0.2-1')}) <= floor(count(*) OVER () * 0.2::DOUBLE) AS hit,
  {hash_sql('product_id', 'corrupt-0.2-1-kind')} % 3 AS kind FROM shipments) t""",
)
def l7(spark, sf):
    """A share column of ones shows which rows lose their materials."""
    df = shipments(spark, sf).withColumn("all", F.lit(1.0))
    out = split.corrupt(df, "product_id", 0.2, 1, shares=["all"])
    return out.select(
        "product_id",
        "weight_kg",
        "total_distance_km",
        (F.col("all") == 0).cast("bigint").alias("lost_materials"),
    )
