"""Queries of the validation and repair group."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.checks.registry import (
    SHIPMENTS,
    case_map,
    ctes,
    final_shipments,
    in_list,
    names_any_sql,
    parsed,
    query,
    r,
    rounded,
    with_long,
)
from weftline.constants import (
    CATEGORY_RENAMES,
    CATEGORY_STANDARD,
    ERRONEOUS_AUDIT,
    ERRONEOUS_FINAL,
    EXPECTED_PARENT,
    GENDER_RECODE,
    GENDERS,
    MATERIAL_RENAMES_FULL,
    MATERIALS,
    PARENTS,
)
from weftline.operators import clean, compose
from weftline.plans import cleanup
from weftline.schema import PRODUCT_COLUMNS, assert_schema
from weftline.sources.shipments import shipments, table

PLAIN = ctes(SHIPMENTS)
PARSED = ctes(SHIPMENTS, parsed())
ALL = ", ".join(["product_id", *PRODUCT_COLUMNS])


@query("v1_assert_schema", PLAIN + f"SELECT {', '.join(PRODUCT_COLUMNS)} FROM shipments")
def v1(spark, sf):
    return assert_schema(shipments(spark, sf).drop("product_id"))


@query(
    "v2_null_profile",
    PLAIN
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_null,
 {r(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*)')} AS pct FROM shipments"""
        for c in PRODUCT_COLUMNS
    )
    + f""" UNION ALL SELECT '*', count(*) FILTER (WHERE bad), {r('count(*) FILTER (WHERE bad) * 100.0::DOUBLE / count(*)')}
 FROM (SELECT {' OR '.join(f'{c} IS NULL' for c in PRODUCT_COLUMNS)} AS bad FROM shipments) t""",
)
def v2(spark, sf):
    return rounded(clean.null_profile(shipments(spark, sf), PRODUCT_COLUMNS))


@query(
    "v3_drop_incomplete",
    PLAIN + f"SELECT {ALL} FROM shipments WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in PRODUCT_COLUMNS),
)
def v3(spark, sf):
    return clean.drop_incomplete(shipments(spark, sf))


_HEADERS = """lines AS (SELECT product_id, CASE WHEN manufacturer_country LIKE '%7' THEN 'product_name' ELSE product_name END AS product_name,
 CASE WHEN manufacturer_country LIKE '%9' THEN 'gender' WHEN manufacturer_country LIKE '%5' THEN NULL ELSE gender END AS gender
 FROM shipments)"""


@query(
    "v4_drop_header_rows",
    ctes(SHIPMENTS, _HEADERS)
    + "SELECT * FROM lines WHERE coalesce(gender, '') <> 'gender' AND coalesce(product_name, '') <> 'product_name'",
)
def v4(spark, sf):
    """Header text planted by country, as if files had been concatenated."""
    country = F.col("manufacturer_country")
    lines = shipments(spark, sf).select(
        "product_id",
        F.when(country.endswith("7"), "product_name").otherwise(F.col("product_name")).alias("product_name"),
        F.when(country.endswith("9"), "gender")
        .when(country.endswith("5"), None)
        .otherwise(F.col("gender"))
        .alias("gender"),
    )
    return clean.drop_header_rows(lines)


@query(
    "v5_recode_gender",
    PLAIN
    + f"SELECT product_id, {case_map('gender', GENDER_RECODE)} AS gender, CAST(NULL AS BIGINT) AS n FROM shipments"
    + f" UNION ALL SELECT '*', gender, count(*) FROM shipments WHERE gender NOT IN {in_list(GENDERS)} GROUP BY gender",
)
def v5(spark, sf):
    """Recoded rows, then the values that were outside the domain before."""
    source = shipments(spark, sf)
    rows = clean.recode_gender(source).select("product_id", "gender", F.lit(None).cast("bigint").alias("n"))
    outside = clean.outside_domain(source, "gender", GENDERS)
    return rows.unionByName(outside.select(F.lit("*").alias("product_id"), F.col("value").alias("gender"), "n"))


@query(
    "v6_recode_category",
    PLAIN + f"SELECT product_id, {case_map('category', CATEGORY_RENAMES)} AS category FROM shipments",
)
def v6(spark, sf):
    return clean.recode_category(shipments(spark, sf)).select("product_id", "category")


@query(
    "v7_standardise_category",
    PLAIN + f"SELECT product_id, {case_map('category', CATEGORY_STANDARD)} AS category FROM shipments",
)
def v7(spark, sf):
    return clean.standardise_category(shipments(spark, sf)).select("product_id", "category")


# product names of the test data hold no dress words, so the country number stands in for them
_DRESS_NAME = """CASE right(manufacturer_country, 1) WHEN '1' THEN 'Maxi ' WHEN '2' THEN 'Midi ' WHEN '3' THEN 'Mini '
 WHEN '4' THEN 'Gown ' ELSE '' END || product_name"""


@query(
    "v8_fix_orphan_category",
    PLAIN
    + f"""SELECT product_id,
 CASE WHEN category = 'Dresses' THEN CASE WHEN nm LIKE '%Maxi%' THEN 'Maxi Dresses' WHEN nm LIKE '%Midi%' THEN 'Midi Dresses'
   WHEN nm LIKE '%Mini%' THEN 'Mini Dresses' WHEN nm LIKE '%Gown%' THEN 'Gowns' ELSE 'Maxi Dresses' END
  WHEN parent_category = 'Maxi' AND category = 'Maxi' THEN 'Maxi Dresses' ELSE category END AS category,
 CASE WHEN parent_category = 'Maxi' THEN 'Dresses' ELSE parent_category END AS parent_category
 FROM (SELECT *, {_DRESS_NAME} AS nm FROM shipments) t""",
)
def v8(spark, sf):
    last = F.right("manufacturer_country", F.lit(1))
    prefix = (
        F.when(last == "1", "Maxi ").when(last == "2", "Midi ").when(last == "3", "Mini ").when(last == "4", "Gown ")
    )
    df = shipments(spark, sf).withColumn(
        "product_name", F.concat(F.coalesce(prefix, F.lit("")), F.col("product_name"))
    )
    return clean.fix_orphan_category(df).select("product_id", "category", "parent_category")


@query(
    "v9_drop_hierarchy_anomalies",
    PLAIN
    + f"SELECT {ALL} FROM shipments WHERE parent_category IN {in_list(PARENTS)} AND category NOT IN {in_list(PARENTS)}",
)
def v9(spark, sf):
    return clean.drop_hierarchy_anomalies(shipments(spark, sf))


@query(
    "v10_drop_category_parent_mismatch",
    PLAIN + f"SELECT {ALL} FROM shipments WHERE NOT (category = 'Maxi' AND parent_category = 'Maxi')",
)
def v10(spark, sf):
    return clean.drop_category_parent_mismatch(shipments(spark, sf))


@query(
    "v11_drop_erroneous_materials",
    PARSED + f"SELECT {ALL} FROM parsed WHERE NOT {names_any_sql(ERRONEOUS_FINAL)}",
)
def v11(spark, sf):
    return clean.drop_erroneous_materials(shipments(spark, sf))


def renamed_sql(mapping: dict[str, str]) -> str:
    return f"""SELECT product_id, material, arg_max(share, pos) AS share FROM (
 SELECT product_id, {case_map('k', mapping)} AS material, json_extract(j, '$.' || k)::DOUBLE AS share, pos FROM
 (SELECT product_id, j, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS pos FROM parsed WHERE j IS NOT NULL) a) b
 GROUP BY product_id, material"""


@query("v12_rename_materials", PARSED + renamed_sql(MATERIAL_RENAMES_FULL))
def v12(spark, sf):
    renamed = clean.rename_materials(shipments(spark, sf))
    return compose.explode_materials(compose.with_composition(renamed), ["product_id"])


# silk plays the impossible material, because the test data has no real one
@query("v13_drop_impossible_materials", PARSED + f"SELECT {ALL} FROM parsed WHERE NOT {names_any_sql(['silk'])}")
def v13(spark, sf):
    return clean.drop_impossible_materials(shipments(spark, sf), ["silk"])


@query(
    "v14_coerce_numeric",
    PLAIN
    + """SELECT * FROM (SELECT product_id,
 TRY_CAST(CAST(weight_kg AS VARCHAR) || CASE WHEN manufacturer_country LIKE '%3' THEN ' kg' ELSE '' END AS DOUBLE) AS weight_kg,
 total_distance_km FROM shipments) t WHERE weight_kg IS NOT NULL AND total_distance_km IS NOT NULL""",
)
def v14(spark, sf):
    """Weights as text; the products of some countries carry a unit and cannot be read."""
    unit = F.when(F.col("manufacturer_country").endswith("3"), " kg").otherwise("")
    df = shipments(spark, sf).select(
        "product_id", F.concat(F.col("weight_kg").cast("string"), unit).alias("weight_kg"), "total_distance_km"
    )
    return clean.coerce_numeric(df, ["weight_kg", "total_distance_km"])


@query(
    "v15_range_filter",
    PLAIN
    + f"""SELECT {ALL} FROM shipments WHERE weight_kg BETWEEN 0.01::DOUBLE AND 50 AND total_distance_km BETWEEN 1 AND 40000""",
)
def v15(spark, sf):
    return clean.range_filter(shipments(spark, sf))


@query(
    "v15_range_report",
    PLAIN
    + """SELECT 'weight_kg' AS "column", count(*) FILTER (WHERE weight_kg < 0.01::DOUBLE) AS n_low,
 count(*) FILTER (WHERE weight_kg > 50) AS n_high, count(*) FILTER (WHERE weight_kg IS NULL) AS n_missing FROM shipments
 UNION ALL SELECT 'total_distance_km', count(*) FILTER (WHERE total_distance_km < 1),
 count(*) FILTER (WHERE total_distance_km > 40000), count(*) FILTER (WHERE total_distance_km IS NULL) FROM shipments""",
)
def v15_report(spark, sf):
    return clean.range_report(shipments(spark, sf))


@query(
    "v16_fix_weight_units",
    PLAIN
    + """SELECT product_id, CASE WHEN w > 10 THEN w / 1000 ELSE w END AS weight_kg FROM
 (SELECT product_id, CASE WHEN weight_kg < 0.01::DOUBLE THEN weight_kg * 1000 ELSE weight_kg END AS w FROM shipments) t""",
)
def v16(spark, sf):
    return clean.fix_weight_units(shipments(spark, sf)).select("product_id", "weight_kg")


@query("v17_drop_distance_outliers", PLAIN + f"SELECT {ALL} FROM shipments WHERE total_distance_km <= 40000")
def v17(spark, sf):
    return clean.drop_distance_outliers(shipments(spark, sf))


_EXTRA = """extra AS (SELECT p_name AS product_name, 'Female' AS gender, 'Dresses' AS parent_category, 'Gowns' AS category,
 p_brand AS manufacturer_country, '{"silk": 1.0}' AS materials,
 TRY_CAST(CASE WHEN p_size % 7 = 0 THEN 'heavy' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS weight_kg,
 p_retailprice AS total_distance_km FROM part)"""


@query(
    "v18_union_extra",
    ctes(SHIPMENTS, _EXTRA)
    + f"""SELECT * FROM (SELECT {', '.join(PRODUCT_COLUMNS)} FROM shipments UNION ALL SELECT * FROM extra) u
 WHERE weight_kg IS NOT NULL AND total_distance_km IS NOT NULL""",
)
def v18(spark, sf):
    """Parts as extra products; some of their weights are words."""
    base = shipments(spark, sf).drop("product_id").withColumn("weight_kg", F.col("weight_kg").cast("string"))
    extra = table(spark, sf, "part").select(
        F.col("p_name").alias("product_name"),
        F.lit("Female").alias("gender"),
        F.lit("Dresses").alias("parent_category"),
        F.lit("Gowns").alias("category"),
        F.col("p_brand").alias("manufacturer_country"),
        F.lit('{"silk": 1.0}').alias("materials"),
        F.when(F.col("p_size") % 7 == 0, "heavy").otherwise(F.col("p_size").cast("string")).alias("weight_kg"),
        F.col("p_retailprice").alias("total_distance_km"),
    )
    return clean.union_extra(base, extra, ["weight_kg", "total_distance_km"])


_DEDUP = "product_name, gender, parent_category, category, manufacturer_country, materials"


@query(
    "v19_deduplicate_exact",
    PLAIN + f"SELECT DISTINCT {_DEDUP} FROM (SELECT * FROM shipments UNION ALL SELECT * FROM shipments) t",
)
def v19(spark, sf):
    source = shipments(spark, sf).select(*_DEDUP.split(", "))
    return clean.deduplicate_exact(source.unionByName(source))


_RULES = {
    "gender": f"gender IN {in_list(GENDERS)}",
    "category": f"category IN {in_list(EXPECTED_PARENT)}",
    "country": "manufacturer_country IN (SELECT n_name FROM nation WHERE n_regionkey <> 2)",
    "materials": "CASE WHEN j IS NULL THEN false ELSE abs(list_sum([json_extract(j, '$.' || k)::DOUBLE for k in json_keys(j)]) - 1)"
    " <= 0.01::DOUBLE END",
    "weight": "weight_kg BETWEEN 0.05::DOUBLE AND 5",
    "distance": "total_distance_km BETWEEN 100 AND 25000",
}


@query(
    "v20_flag_rules",
    PARSED
    + " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, count(*) FILTER (WHERE {test}) AS n_pass,
 count(*) - count(*) FILTER (WHERE {test}) AS n_fail,
 {r(f'(count(*) - count(*) FILTER (WHERE {test})) * 100.0::DOUBLE / count(*)')} AS pct_fail FROM parsed"""
        for rule, test in _RULES.items()
    ),
)
def v20(spark, sf):
    """Countries outside one region play the valid country codes."""
    countries = table(spark, sf, "nation").where(F.col("n_regionkey") != 2).select("n_name")
    return rounded(clean.rule_rates(clean.flag_rules(shipments(spark, sf), countries)))


@query(
    "v21_validate_generated",
    PARSED
    + f"""SELECT {ALL} FROM parsed WHERE j IS NOT NULL
 AND len(list_filter(json_keys(j), lambda k: k NOT IN {in_list(MATERIALS + ['polyster_virgin', 'poliamide_6'])})) = 0
 AND weight_kg BETWEEN 0.05::DOUBLE AND 3 AND total_distance_km BETWEEN 100 AND 40000
 AND weight_kg * 10 <> floor(weight_kg * 10) AND total_distance_km % 100 <> 0""",
)
def v21(spark, sf):
    return clean.validate_generated(shipments(spark, sf))


@query(
    "v22_audit",
    ctes(
        SHIPMENTS,
        parsed(),
        f"""tagged AS (SELECT CASE WHEN {names_any_sql(ERRONEOUS_AUDIT)} THEN 1
 WHEN {names_any_sql(['polyester_organic'])} THEN 2 WHEN weight_kg IS NULL OR total_distance_km IS NULL THEN 3
 WHEN NOT weight_kg BETWEEN 0.01::DOUBLE AND 50 THEN 4 WHEN NOT total_distance_km BETWEEN 1 AND 40000 THEN 5 END AS s FROM parsed)""",
        """steps(step_no, step) AS (VALUES (1, 'erroneous materials'), (2, 'impossible materials'), (3, 'missing numbers'),
 (4, 'weight out of range'), (5, 'distance out of range'))""",
    )
    + f"""SELECT CAST(step_no AS BIGINT) AS step_no, step, (SELECT count(*) FROM tagged WHERE s = step_no) AS removed,
 (SELECT count(*) FROM tagged) - (SELECT count(*) FROM tagged WHERE s <= step_no) AS remaining,
 {r('(SELECT count(*) FROM tagged WHERE s = step_no) * 100.0::DOUBLE / (SELECT count(*) FROM tagged)')} AS pct_removed FROM steps""",
)
def v22(spark, sf):
    return with_long(rounded(clean.audit(shipments(spark, sf), cleanup.comprehensive_steps())))


@query(
    "v23_build_final_dataset",
    ctes(SHIPMENTS, final_shipments().replace("WHERE total_distance_km <= 40000", "")) + f"SELECT {ALL} FROM cleaned",
)
def v23(spark, sf):
    return cleanup.build_final_dataset(shipments(spark, sf))


_V24_CATEGORY = case_map(
    "(CASE WHEN category = 'Dresses' THEN 'Gowns' WHEN category = 'Maxi' AND parent_category = 'Maxi' THEN 'Maxi Dresses' ELSE category END)",
    CATEGORY_STANDARD,
)


@query(
    "v24_comprehensive_cleanup",
    ctes(
        SHIPMENTS,
        "parsed0 AS (SELECT *, CASE WHEN json_valid(replace(materials, '''', '\"')) THEN replace(materials, '''', '\"') END AS j FROM shipments)",
        f"""parsed AS (SELECT * FROM parsed0 WHERE NOT {names_any_sql(ERRONEOUS_AUDIT + ['polyester_organic'])}
 AND weight_kg BETWEEN 0.01::DOUBLE AND 50 AND total_distance_km BETWEEN 1 AND 40000)""",
        f"m AS ({renamed_sql(MATERIAL_RENAMES_FULL)})",
    )
    + f"""SELECT p.product_id, {_V24_CATEGORY} AS category,
 CASE WHEN parent_category = 'Maxi' THEN 'Dresses' ELSE parent_category END AS parent_category,
 weight_kg, total_distance_km, m.material, m.share FROM parsed p LEFT JOIN m ON p.product_id = m.product_id""",
)
def v24(spark, sf):
    out = compose.with_composition(cleanup.comprehensive_cleanup(shipments(spark, sf)))
    return out.select(
        "product_id",
        "category",
        "parent_category",
        "weight_kg",
        "total_distance_km",
        F.explode_outer("composition").alias("material", "share"),
    )
