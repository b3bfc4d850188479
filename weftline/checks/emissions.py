"""Queries of the footprint group."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.checks.registry import (
    FACTORS,
    SHIPMENTS,
    SHIPMENTS_FP,
    ctes,
    factor_table,
    footprints,
    mode_table,
    parsed,
    query,
    r,
    rnd,
    rounded,
    shares,
    shipments_fp,
    split_terms,
    weighted_ef,
    with_long,
)
from weftline.constants import MATERIALS
from weftline.operators import compose, emissions
from weftline.schema import TARGETS
from weftline.sources.shipments import shipments, table

FP_RAW = ctes(SHIPMENTS, FACTORS, footprints("shipments"))
PLAIN = ctes(SHIPMENTS)
DIMS = ["category", "parent_category", "gender", "manufacturer_country"]


@query("f1_material_carbon", FP_RAW + f"SELECT product_id, {r('carbon_material')} AS carbon_material FROM fp")
def f1(spark, sf):
    df = shipments(spark, sf).where(F.col("materials").isNotNull())
    out = emissions.material_footprint(compose.with_composition(df), factor_table(spark))
    return out.select("product_id", rnd("carbon_material").alias("carbon_material"))


@query("f2_material_water", FP_RAW + f"SELECT product_id, {r('water_total')} AS water_total FROM fp")
def f2(spark, sf):
    """Water with the plan for factor tables too large for literals."""
    df = shipments(spark, sf).where(F.col("materials").isNotNull())
    factors = factor_table(spark)
    factors.rows = None
    out = emissions.material_footprint(compose.with_composition(df), factors)
    return out.select("product_id", rnd("water_total").alias("water_total"))


@query(
    "f3_modal_split",
    PLAIN
    + "SELECT product_id, "
    + ", ".join(f"{r(e, 9)} AS p_{m}" for m, e in split_terms().items())
    + " FROM shipments",
)
def f3(spark, sf):
    modes = mode_table(spark)
    out = emissions.with_modal_split(shipments(spark, sf), "total_distance_km", modes)
    return out.select("product_id", *[rnd(f"p_{m}", 9).alias(f"p_{m}") for m in modes.names])


@query("f4_weighted_emission_factor", PLAIN + f"SELECT product_id, {r(weighted_ef())} AS ef_weighted FROM shipments")
def f4(spark, sf):
    out = emissions.with_emission_factor(shipments(spark, sf), "total_distance_km", mode_table(spark))
    return out.select("product_id", rnd("ef_weighted").alias("ef_weighted"))


@query(
    "f5_transport_carbon",
    PLAIN
    + f"""SELECT product_id, CASE WHEN weight_kg > 0 AND total_distance_km > 0 THEN 'ok' ELSE 'invalid trip' END AS status,
 {r(f'CASE WHEN weight_kg > 0 AND total_distance_km > 0 THEN weight_kg / 1000 * total_distance_km * {weighted_ef()} / 1000 ELSE 0 END', 9)}
 AS carbon_transport FROM shipments""",
)
def f5(spark, sf):
    out = emissions.with_transport_carbon(shipments(spark, sf), "weight_kg", "total_distance_km", mode_table(spark))
    valid = emissions.valid_trip(F.col("weight_kg"), F.col("total_distance_km"))
    return out.select(
        "product_id",
        F.when(valid, "ok").otherwise("invalid trip").alias("status"),
        rnd("carbon_transport", 9).alias("carbon_transport"),
    )


@query(
    "f6_emission_intensity",
    PLAIN + f"SELECT product_id, {r(weighted_ef() + ' / 1000', 9)} AS kg_per_tkm FROM shipments",
)
def f6(spark, sf):
    out = emissions.with_emission_intensity(shipments(spark, sf), "total_distance_km", mode_table(spark))
    return out.select("product_id", rnd("kg_per_tkm", 9).alias("kg_per_tkm"))


@query(
    "f7_product_footprint",
    FP_RAW
    + f"""SELECT product_id, CAST(NULL AS VARCHAR) AS reason, {', '.join(f'{r(t)} AS {t}' for t in TARGETS)} FROM fp
 UNION ALL SELECT product_id, 'no composition text', NULL, NULL, NULL, NULL FROM shipments WHERE materials IS NULL""",
)
def f7(spark, sf):
    """All rows in one pass: accepted ones with their outputs, rejected ones with a reason."""
    done = emissions.footprint_or_reason(shipments(spark, sf), factor_table(spark), mode_table(spark))
    return done.select("product_id", "reason", *[rnd(t).alias(t) for t in TARGETS])


@query(
    "f8_modal_split_check",
    ctes(
        SHIPMENTS,
        "s AS (SELECT product_id, " + ", ".join(f"{e} AS p_{m}" for m, e in split_terms().items()) + " FROM shipments)",
    )
    + f"""SELECT product_id, {r('p_road + p_rail + p_inland_waterway + p_sea + p_air')} AS probability_sum,
 CAST(CASE WHEN p_road IS NOT NULL AND abs(p_road + p_rail + p_inland_waterway + p_sea + p_air - 1) <= 1e-6
      AND least(p_road, p_rail, p_inland_waterway, p_sea, p_air) >= 0
      AND greatest(p_road, p_rail, p_inland_waterway, p_sea, p_air) <= 1 THEN 1 ELSE 0 END AS BIGINT) AS split_valid
 FROM s""",
)
def f8(spark, sf):
    out = emissions.modal_split_check(shipments(spark, sf), "total_distance_km", mode_table(spark))
    return with_long(rounded(out.select("product_id", "probability_sum", "split_valid")))


@query(
    "f9_mode_average_factor",
    f"""WITH sub AS (SELECT p_type AS mode, p_brand AS subtype, avg(p_retailprice) AS ef, count(*) AS n FROM part GROUP BY ALL),
 shared AS (SELECT mode, ef, n / CAST(sum(n) OVER (PARTITION BY mode) AS DOUBLE) AS share FROM sub)
 SELECT mode, {r('sum(ef * share)')} AS ef, {r('sum(share)')} AS share_sum, count(*) AS n_subtypes,
 CAST(CASE WHEN abs(sum(share) - 1) <= 0.01::DOUBLE THEN 1 ELSE 0 END AS BIGINT) AS share_ok FROM shared GROUP BY mode""",
)
def f9(spark, sf):
    """Part types as modes, brands as subtypes, their counts as usage."""
    from pyspark.sql import Window as W

    sub = table(spark, sf, "part").groupBy(F.col("p_type").alias("mode"), "p_brand").agg(
        F.avg("p_retailprice").alias("ef"), F.count(F.lit(1)).alias("n")
    )
    shared = sub.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("mode")).cast("double"))
    return with_long(rounded(emissions.mode_average_factor(shared)))


@query(
    "f10_formula_features",
    ctes(SHIPMENTS, FACTORS, parsed(), shares("product_id, weight_kg"))
    + f"""SELECT p.product_id,
 {r('max(CASE WHEN p.weight_kg IS NOT NULL THEN m.c END)')} AS formula_carbon_material,
 {r('max(p.weight_kg / 1000 * p.total_distance_km * 0.05::DOUBLE)', 9)} AS formula_carbon_transport,
 {r('max(CASE WHEN p.weight_kg IS NOT NULL THEN m.w END)')} AS formula_water_total
 FROM parsed p LEFT JOIN (SELECT s.product_id, sum(s.weight_kg * s.share * f.carbon) AS c,
   sum(s.weight_kg * s.share * f.water) AS w FROM shares s JOIN factors f ON s.material = f.material
   GROUP BY s.product_id) m ON p.product_id = m.product_id GROUP BY p.product_id""",
)
def f10(spark, sf):
    wide = compose.pivot_materials(compose.with_composition(shipments(spark, sf)))
    out = emissions.formula_features(wide, factor_table(spark), MATERIALS)
    return out.select(
        "product_id",
        rnd("formula_carbon_material").alias("formula_carbon_material"),
        rnd("formula_carbon_transport", 9).alias("formula_carbon_transport"),
        rnd("formula_water_total").alias("formula_water_total"),
    )


@query(
    "f11_footprint_rollup",
    SHIPMENTS_FP
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n, "
        + ", ".join(f"{r(f'sum({t})', 3)} AS sum_{t}, {r(f'avg({t})')} AS avg_{t}" for t in TARGETS)
        + f" FROM fp WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in DIMS
    ),
)
def f11(spark, sf):
    out = emissions.footprint_rollup(shipments_fp(spark, sf), DIMS, TARGETS)
    return out.select(
        "dim",
        "value",
        "n",
        *[rnd(f"sum_{t}", 3).alias(f"sum_{t}") for t in TARGETS],
        *[rnd(f"avg_{t}").alias(f"avg_{t}") for t in TARGETS],
    )


@query(
    "f12_factor_ranking",
    f"""SELECT p_brand || '/' || p_type AS material, {r('avg(p_retailprice)')} AS carbon FROM part GROUP BY ALL
 ORDER BY carbon DESC, material LIMIT 10""",
)
def f12(spark, sf):
    """Brands and types stand in for materials, so that the ranking reads a whole table."""
    factors = (
        table(spark, sf, "part")
        .groupBy(F.concat_ws("/", "p_brand", "p_type").alias("material"))
        .agg(rnd(F.avg("p_retailprice")).alias("carbon"))
    )
    return emissions.factor_ranking(factors)
