"""Queries of the feature group.

Each SQL piece ``x<i>`` computes the features of one operator from the base ``e0``; the full
feature matrix joins the pieces.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.checks.registry import (
    FACTORS,
    SHIPMENTS,
    SHIPMENTS_FP,
    ctes,
    factor_table,
    in_list,
    parsed,
    query,
    r,
    rounded,
    shares,
    with_long,
)
from weftline.checks.sources import split_table
from weftline.checks.split import hash_sql
from weftline.constants import HIGH_CARBON, MATERIALS, NATURAL, SYNTHETIC
from weftline.functions.folds import fold_of
from weftline.operators import compose, emissions, features
from weftline.operators.features import CATEGORICALS, ENCODED_TARGETS, FORMULA, Preprocessor, target_feature
from weftline.schema import NUMERICS
from weftline.session import persist_state, scratch_path
from weftline.sources.shipments import shipments

WIDE = ["product_id", "gender", "parent_category", "category", *NUMERICS, *MATERIALS]


def _vector(source: str) -> str:
    """CTEs fs (shares inside the vocabulary) and v (their aggregates per product)."""
    return f"""{parsed(source, 'fpj')},
{shares('product_id', 'fpj', 'fs0')},
fs AS MATERIALIZED (SELECT s.product_id, s.material, s.share, v.idx, f.carbon, f.water FROM fs0 s JOIN vocab v ON s.material = v.material
 JOIN factors f ON s.material = f.material),
v AS MATERIALIZED (SELECT product_id, max(share) AS top, count(*) FILTER (WHERE share > 0) AS n, sum(share) AS total,
 sum(share) FILTER (WHERE material IN {in_list(HIGH_CARBON)}) AS high, sum(share) FILTER (WHERE material IN {in_list(SYNTHETIC)}) AS syn,
 sum(share) FILTER (WHERE material IN {in_list(NATURAL)}) AS nat, sum(share * carbon) AS ci, sum(share * water) AS wi,
 arg_min(idx, (-share, idx)) AS dom, max(carbon) FILTER (WHERE share > 0) AS maxc, max(water) FILTER (WHERE share > 0) AS maxw
 FROM fs GROUP BY product_id),
e0 AS MATERIALIZED (SELECT p.*, coalesce(p.weight_kg, 0) AS w, coalesce(v.top, 0) AS top, coalesce(v.n, 0) AS n, coalesce(v.total, 0) AS total,
 coalesce(v.high, 0) AS high, coalesce(v.syn, 0) AS syn, coalesce(v.nat, 0) AS nat, coalesce(v.ci, 0) AS ci, coalesce(v.wi, 0) AS wi,
 coalesce(v.dom, 0) AS dom, coalesce(v.maxc, 0) AS maxc, coalesce(v.maxw, 0) AS maxw,
 {hash_sql('p.product_id', 42)} % 5 AS fold FROM {source} p LEFT JOIN v ON p.product_id = v.product_id)"""


RAW = ctes(SHIPMENTS, FACTORS, _vector("shipments"))
#: the rows outside each fold, once per fold, as one stored block without a join
_HELD = "held AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT {k} AS h, category, parent_category, gender, carbon_material, carbon_transport, water_total, weight_kg, ci, wi"
    f" FROM e0 WHERE fold <> {k}"
    for k in range(5)
) + ")"
BASE = SHIPMENTS_FP.rstrip() + ",\n" + _vector("fp") + ",\n" + _HELD + "\n"

X1 = f"""SELECT product_id, {r('top')} AS primary_material_pct, n AS material_diversity, {r('w * top')} AS weight_x_primary_pct,
 {r('w * total')} AS weight_x_total_material, {r('high')} AS high_carbon_material_pct, {r('syn')} AS synthetic_material_pct,
 {r('nat')} AS natural_material_pct, {r('w * high')} AS weight_x_high_carbon, {r('w * syn')} AS weight_x_synthetic,
 {r('w * nat')} AS weight_x_natural FROM e0"""
X2 = f"""SELECT product_id, {r('ci')} AS material_carbon_intensity, {r('wi')} AS material_water_intensity,
 {r('w * ci')} AS weight_x_carbon_intensity, {r('w * wi')} AS weight_x_water_intensity FROM e0"""
X3 = f"""SELECT product_id, CAST(dom AS BIGINT) AS dominant_material_idx, f.carbon AS dominant_material_carbon,
 f.water AS dominant_material_water, CAST(high > 0.1::DOUBLE AS BIGINT) AS is_high_impact_material,
 {r('maxc')} AS max_material_carbon_factor, {r('maxw')} AS max_material_water_factor
 FROM e0 JOIN vocab ON vocab.idx = dom JOIN factors f ON f.material = vocab.material"""
X4 = """SELECT product_id, CAST(weight_kg IS NULL AS BIGINT) AS weight_kg_missing,
 CAST(total_distance_km IS NULL AS BIGINT) AS total_distance_km_missing, CAST(total = 0 AS BIGINT) AS materials_missing,
 CAST(category IS NULL AS BIGINT) AS category_missing, CAST(parent_category IS NULL AS BIGINT) AS parent_category_missing,
 CAST(gender IS NULL AS BIGINT) AS gender_missing FROM e0"""
X5 = f"""SELECT product_id, {r('coalesce(weight_kg, (SELECT median(weight_kg) FROM e0))')} AS weight_imputed,
 CAST(weight_kg IS NULL AS BIGINT) AS weight_is_imputed,
 CAST(weight_kg IS NOT NULL AND total > 0 AS BIGINT) AS formula_is_available,
 CAST(weight_kg IS NULL OR total = 0 OR total_distance_km IS NULL AS BIGINT) AS any_critical_missing FROM e0"""
X6 = "SELECT product_id, " + ", ".join(f"{c}_encoded" for c in CATEGORICALS) + " FROM e0 " + " ".join(
    f"JOIN (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS {c}_encoded FROM (SELECT DISTINCT {c} FROM e0) d{i}) c{i}"
    f" ON e0.{c} = c{i}.{c}"
    for i, c in enumerate(CATEGORICALS)
)
X7 = f"""SELECT e0.product_id, {r('c.ac')} AS category_avg_carbon, {r('c.aw')} AS category_avg_water, {r('c.ag')} AS category_avg_weight,
 {r('c.mc')} AS category_median_carbon, {r('p.ac')} AS parent_category_avg_carbon, {r('p.aw')} AS parent_category_avg_water,
 {r('(SELECT avg(carbon_material) FROM e0)')} AS global_avg_carbon, {r('(SELECT avg(water_total) FROM e0)')} AS global_avg_water
 FROM e0 LEFT JOIN (SELECT category, h, avg(carbon_material) AS ac, avg(water_total) AS aw, avg(weight_kg) AS ag, median(carbon_material) AS mc
   FROM held GROUP BY category, h) c ON c.category = e0.category AND c.h = e0.fold
 LEFT JOIN (SELECT parent_category, h, avg(carbon_material) AS ac, avg(water_total) AS aw
   FROM held GROUP BY parent_category, h) p ON p.parent_category = e0.parent_category AND p.h = e0.fold"""
X8 = f"""SELECT e0.product_id, {r('k.code / k.top::DOUBLE * ci')} AS category_x_carbon_intensity,
 {r('k.code / k.top::DOUBLE * wi')} AS category_x_water_intensity, {r('c.ac')} AS category_material_avg_carbon,
 {r('c.aw')} AS category_material_avg_water
 FROM e0 JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code, count(*) OVER () - 1 AS top
   FROM (SELECT DISTINCT category FROM e0) d) k ON k.category = e0.category
 LEFT JOIN (SELECT category, h, avg(ci) AS ac, avg(wi) AS aw FROM held GROUP BY category, h) c
   ON c.category = e0.category AND c.h = e0.fold"""
X9 = (
    "SELECT e0.product_id, "
    + ", ".join(
        r(f"(t{i}.n{j} * t{i}.m{j} + 20 * g.m{j}) / (t{i}.n{j} + 20)") + f" AS {target_feature(c, t)}"
        for i, c in enumerate(CATEGORICALS)
        for j, t in enumerate(ENCODED_TARGETS)
    )
    + " FROM e0 "
    + " ".join(
        f"LEFT JOIN (SELECT {c}, h, "
        + ", ".join(f"avg({t}) AS m{j}, count({t}) AS n{j}" for j, t in enumerate(ENCODED_TARGETS))
        + f" FROM held GROUP BY {c}, h) t{i} ON t{i}.{c} = e0.{c} AND t{i}.h = e0.fold"
        for i, c in enumerate(CATEGORICALS)
    )
    + " LEFT JOIN (SELECT h, "
    + ", ".join(f"avg({t}) AS m{j}" for j, t in enumerate(ENCODED_TARGETS))
    + f" FROM held GROUP BY h) g ON g.h = e0.fold"
)
X10 = f"""SELECT product_id, {r('(wf - avg(wf) OVER ()) / stddev_pop(wf) OVER ()')} AS weight_kg,
 {r('(df - avg(df) OVER ()) / stddev_pop(df) OVER ()')} AS total_distance_km FROM
 (SELECT product_id, coalesce(weight_kg, (SELECT median(weight_kg) FROM e0)) AS wf,
  coalesce(total_distance_km, (SELECT median(total_distance_km) FROM e0)) AS df FROM e0) t"""
X11 = f"""SELECT product_id, {', '.join(f'{r(f"ln(1 + ({c} - min({c}) OVER () + 1))")} AS {c}' for c in FORMULA)} FROM
 (SELECT product_id, CASE WHEN weight_kg IS NOT NULL AND total > 0 THEN weight_kg * ci END AS formula_carbon_material,
  weight_kg / 1000 * total_distance_km * 0.05::DOUBLE AS formula_carbon_transport,
  CASE WHEN weight_kg IS NOT NULL AND total > 0 THEN weight_kg * wi END AS formula_water_total FROM e0) t"""


def stored_split(spark, sf):
    return persist_state(split_table(spark, sf), "split")


def raw_wide(spark, sf):
    """Uncleaned shipments with share columns: gaps in every input."""
    return compose.pivot_materials(compose.with_composition(shipments(spark, sf))).select(*WIDE)


def show(df, columns):
    return with_long(rounded(df.select("product_id", *columns)))


@query("e1_interaction_features", RAW + X1)
def e1(spark, sf):
    return show(features.interaction_features(raw_wide(spark, sf)), features.INTERACTIONS)


@query("e2_intensity_features", RAW + X2)
def e2(spark, sf):
    return show(features.intensity_features(raw_wide(spark, sf), factor_table(spark)), features.INTENSITIES)


@query("e3_material_fallback", RAW + X3)
def e3(spark, sf):
    return show(features.material_fallback(raw_wide(spark, sf), factor_table(spark)), features.FALLBACK)


@query("e4_missing_indicators", RAW + X4)
def e4(spark, sf):
    return show(features.missing_indicators(raw_wide(spark, sf)), features.MISSING)


@query("e5_imputation_features", RAW + X5)
def e5(spark, sf):
    df = raw_wide(spark, sf)
    median = features.fit_medians(df, ["weight_kg"])["weight_kg"]
    return show(features.imputation_features(df, median), features.IMPUTATION)


@query(
    "e6_label_encode",
    ctes(SHIPMENTS)
    + "SELECT product_id, "
    + ", ".join(f"coalesce(c{i}.code, -1) AS {c}_encoded" for i, c in enumerate(CATEGORICALS))
    + " FROM shipments s "
    + " ".join(
        f"LEFT JOIN (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM shipments"
        f" WHERE parent_category <> 'Dresses') d{i}) c{i} ON s.{c} = c{i}.{c}"
        for i, c in enumerate(CATEGORICALS)
    ),
)
def e6(spark, sf):
    """Fitted without one parent category, so its values are unseen."""
    df = shipments(spark, sf)
    labels = features.fit_labels(df.where(F.col("parent_category") != "Dresses"), CATEGORICALS)
    return show(features.label_encode(df, labels, CATEGORICALS), [f"{c}_encoded" for c in CATEGORICALS])


def with_fold_statistics(spark, sf, median: str | None = None):
    df = stored_split(spark, sf)
    base = features.intensity_features(df, factor_table(spark)).withColumn("fold", fold_of(F.col("product_id")))
    return base, features.fit_fold_statistics(base, features.STATISTICS_OF, median=median)


@query("e7_category_fallback", BASE + X7)
def e7(spark, sf):
    base, stats = with_fold_statistics(spark, sf, "carbon_material")
    return show(features.category_fallback(base, stats), features.CATEGORY_FALLBACK)


@query("e8_cross_features", BASE + X8)
def e8(spark, sf):
    base, stats = with_fold_statistics(spark, sf)
    labels = features.fit_labels(base, ["category"])
    top = labels.agg(F.max("code")).first()[0]
    coded = features.label_encode(base, labels, ["category"])
    return show(features.cross_features(coded, stats, top), features.CROSS)


@query("e9_target_encode", BASE + X9)
def e9(spark, sf):
    base, stats = with_fold_statistics(spark, sf)
    names = [target_feature(c, t) for c in CATEGORICALS for t in ENCODED_TARGETS]
    return show(features.target_encode(base, stats), names)


@query("e10_scale_numeric", RAW + X10)
def e10(spark, sf):
    df = shipments(spark, sf)
    stats = features.fit_scaler(df, NUMERICS, features.fit_medians(df, NUMERICS))
    return show(features.scale_numeric(df, stats), NUMERICS)


@query("e11_log_shift", RAW + X11)
def e11(spark, sf):
    df = emissions.formula_features(raw_wide(spark, sf), factor_table(spark), MATERIALS)
    return show(features.log_shift(df, features.fit_minimums(df, FORMULA)), FORMULA)


_PIECES = {"x1": X1, "x2": X2, "x3": X3, "x4": X4, "x5": X5, "x6": X6, "x7": X7, "x8": X8, "x9": X9, "x10": X10, "x11": X11}
MATRIX = (
    BASE.rstrip()
    + ",\n"
    + ",\n".join(f"{n} AS ({s})" for n, s in _PIECES.items())
    + ",\nxs AS (SELECT e0.product_id, "
    + ", ".join(f"coalesce(max(s.share) FILTER (WHERE s.material = '{m}'), 0::DOUBLE) AS {m}" for m in MATERIALS)
    + " FROM e0 LEFT JOIN fs s ON e0.product_id = s.product_id GROUP BY e0.product_id)\n"
)
MATRIX_JOIN = "FROM xs " + " ".join(f"JOIN {n} USING (product_id)" for n in _PIECES)


@query("e12_feature_matrix", MATRIX + f"SELECT product_id, {', '.join(features.feature_names())} {MATRIX_JOIN}")
def e12(spark, sf):
    """All 93 features of the training part, out of fold."""
    df = stored_split(spark, sf)
    done = Preprocessor(factor_table(spark)).fit(df).transform(df, training=True, keep=["product_id"])
    return show(done, features.feature_names())


_SAVED = ["weight_kg", "total_distance_km", "category_encoded", "weight_imputed", "global_avg_carbon", *FORMULA]


@query("e13_save_load_state", MATRIX + f"SELECT product_id, {', '.join(_SAVED)} {MATRIX_JOIN}")
def e13(spark, sf):
    """Features that do not depend on the fold, from a saved and reloaded preprocessor."""
    df = stored_split(spark, sf)
    path = scratch_path(spark, "preprocessor")
    Preprocessor(factor_table(spark)).fit(df).save(path)
    return show(Preprocessor.load(spark, path).transform(df, keep=["product_id"]), _SAVED)


@query(
    "e14_group_median_impute",
    ctes(SHIPMENTS)
    + f"""SELECT product_id, {r('coalesce(weight_kg, median(weight_kg) OVER (PARTITION BY category))')} AS weight_kg,
 {r('coalesce(total_distance_km, median(total_distance_km) OVER (PARTITION BY manufacturer_country))')} AS total_distance_km FROM shipments""",
)
def e14(spark, sf):
    rules = {"weight_kg": "category", "total_distance_km": "manufacturer_country"}
    return show(features.group_median_impute(shipments(spark, sf), rules), NUMERICS)


@query(
    "e15_missing_pattern",
    ctes(SHIPMENTS)
    + """SELECT missing_pattern, count(*) AS n FROM (SELECT coalesce(nullif(concat_ws('_', CASE WHEN category IS NULL THEN 'C' END,
 CASE WHEN weight_kg IS NULL THEN 'W' END, CASE WHEN total_distance_km IS NULL THEN 'D' END,
 CASE WHEN materials IS NULL THEN 'M' END), ''), 'COMPLETE') AS missing_pattern FROM shipments) t GROUP BY missing_pattern""",
)
def e15(spark, sf):
    return features.missing_pattern(shipments(spark, sf)).groupBy("missing_pattern").agg(F.count(F.lit(1)).alias("n"))
