"""Queries of the profiling group."""

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
    rnd,
    rounded,
    shares,
    with_long,
)
from weftline.constants import (
    DEFICIT_CATEGORIES,
    DEFICIT_SYNONYMS,
    DISTANCE_BANDS_5,
    DISTANCE_BANDS_8,
    ERRONEOUS_AUDIT,
    ERROR_CLASSES,
    EXPECTED_PARENT,
    FOOTWEAR_MATERIALS,
    FOOTWEAR_ONLY,
    GENDER_RECODE,
    NAME_ISSUES,
    NAMING_VARIANTS,
    PARENTS,
    QUESTIONABLE,
    RARE_ASSESSMENTS,
    TYPICALLY_FEMALE,
    WEIGHT_BANDS_5,
    WEIGHT_BANDS_7,
    WEIGHT_BANDS_7_CLOSED,
)
from weftline.operators import profile
from weftline.plans.cleanup import build_final_dataset
from weftline.sources.shipments import shipments

PLAIN = ctes(SHIPMENTS)
PARSED = ctes(SHIPMENTS, parsed())
KEEP = "product_id, product_name, category, parent_category, gender"
SHARES = ctes(SHIPMENTS, parsed(), shares(KEEP))
DIMS = profile.DIMENSIONS


def pct(part: str, whole: str) -> str:
    return r(f"({part}) * 100.0::DOUBLE / ({whole})")


@query(
    "a1_overview",
    PLAIN + "SELECT count(*) AS n_rows, " + ", ".join(f"count(DISTINCT {d}) AS n_{d}" for d in DIMS) + " FROM shipments",
)
def a1(spark, sf):
    return profile.overview(shipments(spark, sf))


@query(
    "a2_value_counts",
    PLAIN
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM shipments)')} AS pct"
        f" FROM shipments WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in DIMS
    ),
)
def a2(spark, sf):
    return rounded(profile.value_counts(shipments(spark, sf)))


@query(
    "a3_top_k",
    PLAIN + "SELECT category, count(*) AS n FROM shipments GROUP BY category ORDER BY n DESC, category LIMIT 10",
)
def a3(spark, sf):
    return profile.top_k(shipments(spark, sf), "category", 10)


def _describe_sql(column: str) -> str:
    q = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    parts = ", ".join(f"{r(f'quantile_cont({column}, {p})')} AS {n}" for n, p in q.items())
    return f"""SELECT '{column}' AS metric, count({column}) AS n, {r(f'min({column})')} AS min, {r(f'max({column})')} AS max,
 {r(f'avg({column})')} AS mean, {r(f'stddev_samp({column})')} AS std, {parts},
 {r(f'quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)')} AS iqr FROM shipments"""


@query("a4_describe_numeric", PLAIN + _describe_sql("weight_kg") + " UNION ALL " + _describe_sql("total_distance_km"))
def a4(spark, sf):
    return rounded(profile.describe_numeric(shipments(spark, sf), ["weight_kg", "total_distance_km"]))


@query(
    "a5_count_distribution",
    PLAIN
    + f"""SELECT min(n) AS min, max(n) AS max, {r('avg(n)')} AS mean, {r('median(n::DOUBLE)')} AS median,
 {r('stddev_samp(n)')} AS std FROM (SELECT category, count(*) AS n FROM shipments GROUP BY category) t""",
)
def a5(spark, sf):
    return rounded(profile.count_distribution(shipments(spark, sf)))


@query(
    "a6_material_frequency",
    SHARES
    + f"""SELECT material, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM parsed WHERE j IS NOT NULL)')} AS pct,
 (SELECT count(*) FROM parsed WHERE j IS NOT NULL) AS n_parsed, (SELECT count(*) FROM parsed WHERE j IS NULL) AS n_failed
 FROM shares GROUP BY material""",
)
def a6(spark, sf):
    return rounded(profile.material_frequency(shipments(spark, sf)))


@query(
    "a7_hierarchy_counts",
    PLAIN + "SELECT parent_category, category, count(*) AS n FROM shipments GROUP BY ALL",
)
def a7(spark, sf):
    return profile.hierarchy_counts(shipments(spark, sf))


@query(
    "a8_material_by",
    SHARES
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dim, {d} AS value, material, count(*) AS n, {pct('count(*)', f'sum(count(*)) OVER (PARTITION BY {d})')}"
        f" AS pct FROM shares GROUP BY {d}, material"
        for d in ("category", "parent_category", "gender")
    ),
)
def a8(spark, sf):
    return rounded(profile.material_by(shipments(spark, sf), ["category", "parent_category", "gender"]))


@query(
    "a9_material_matrix",
    SHARES
    + """, top AS (SELECT material FROM shares GROUP BY material ORDER BY count(*) DESC, material LIMIT 12),
 parents AS (SELECT DISTINCT parent_category FROM shares)
 SELECT p.parent_category, t.material, (SELECT count(*) FROM shares s WHERE s.parent_category = p.parent_category
  AND s.material = t.material) AS n, (SELECT count(*) FROM shares s WHERE s.parent_category = p.parent_category
  AND s.material IN (SELECT material FROM top)) AS row_total FROM parents p, top t""",
)
def a9(spark, sf):
    """The matrix in long form, because its columns depend on the data."""
    wide = profile.material_matrix(shipments(spark, sf))
    names = [c for c in wide.columns if c not in ("parent_category", "row_total")]
    return wide.unpivot(["parent_category", "row_total"], names, "material", "n")


@query(
    "a10_top_n_per_group",
    SHARES
    + """SELECT * FROM (SELECT parent_category AS grp, material AS name, count(*) AS n,
 row_number() OVER (PARTITION BY parent_category ORDER BY count(*) DESC, material) AS rank FROM shares GROUP BY parent_category, material
 UNION ALL SELECT material, category, count(*), row_number() OVER (PARTITION BY material ORDER BY count(*) DESC, category)
 FROM shares GROUP BY material, category) t WHERE rank <= 5""",
)
def a10(spark, sf):
    """Top materials per parent and top categories per material."""
    long = profile.named_materials(shipments(spark, sf), ["parent_category", "category"])
    n = F.count(F.lit(1)).alias("n")
    by_parent = long.groupBy(F.col("parent_category").alias("grp"), F.col("material").alias("name")).agg(n)
    by_material = long.groupBy(F.col("material").alias("grp"), F.col("category").alias("name")).agg(n)
    tops = [profile.top_n_per_group(c, "grp", "n", "name", 5) for c in (by_parent, by_material)]
    return with_long(tops[0].unionByName(tops[1]))


@query(
    "a11_deficit",
    SHARES
    + f""", d AS (SELECT 'material' AS kind, material AS name, count(*) AS n, 35000 - count(*) AS needed FROM shares
 GROUP BY material HAVING count(*) < 35000
 UNION ALL SELECT 'category', w.name, count(s.category), greatest(25000 - count(s.category), 0) FROM
 (VALUES {', '.join(f"('{c}')" for c in DEFICIT_CATEGORIES)}) w(name) LEFT JOIN
 (SELECT {case_map('category', DEFICIT_SYNONYMS)} AS category FROM shipments) s ON s.category = w.name GROUP BY w.name)
 SELECT kind, name, n, needed, b AS batch_no, least(1000, needed - b * 1000) AS batch_size FROM
 (SELECT *, unnest(range(0, CAST(ceil(needed / 1000.0) AS BIGINT))) AS b FROM d WHERE needed > 0) t""",
)
def a11(spark, sf):
    df = shipments(spark, sf)
    both = (
        profile.material_deficit(df)
        .withColumn("kind", F.lit("material"))
        .unionByName(profile.category_deficit(df).withColumn("kind", F.lit("category")))
    )
    return profile.deficit_batches(both)


@query(
    "a12_gender_split",
    SHARES
    + f"""SELECT material, count(*) FILTER (WHERE gender = 'Male') AS n_male, count(*) FILTER (WHERE gender = 'Female') AS n_female,
 count(*) AS n, {pct("count(*) FILTER (WHERE gender = 'Male')", 'count(*)')} AS pct_male,
 {pct("count(*) FILTER (WHERE gender = 'Female')", 'count(*)')} AS pct_female FROM shares GROUP BY material""",
)
def a12(spark, sf):
    return rounded(profile.gender_split(shipments(spark, sf)))


@query(
    "a13_rarity_tier",
    SHARES
    + """SELECT material, count(*) AS n, CASE WHEN count(*) < 10 THEN 'very_rare' WHEN count(*) < 100 THEN 'rare'
 WHEN count(*) < 1000 THEN 'uncommon' WHEN count(*) < 10000 THEN 'common' ELSE 'very_common' END AS tier
 FROM shares GROUP BY material""",
)
def a13(spark, sf):
    counts = profile.material_frequency(shipments(spark, sf)).select("material", "n")
    return profile.rarity_tier(counts)


# thresholds as shares of all products, so that both tiers have members at any scale
_TIER_SQL = "(SELECT count(*) FROM shipments)"


def _issue_case(index: int) -> str:
    whens = " ".join(
        f"WHEN material = '{n[0][1:]}' THEN '{n[index]}'"
        if n[0].startswith("=")
        else f"WHEN contains(material, '{n[0]}') THEN '{n[index]}'"
        for n in NAME_ISSUES
    )
    return f"CASE {whens} ELSE '{('Unknown', 'Needs review')[index - 1]}' END"


@query(
    "a14_low_usage_issues",
    SHARES
    + f"""SELECT material, n, tier, CASE WHEN tier = 'very_rare' THEN {_issue_case(1)} END AS issue_type,
 CASE WHEN tier = 'very_rare' THEN {_issue_case(2)} END AS correct_form,
 CASE WHEN tier = 'rare' THEN CASE {' '.join(f"WHEN contains(material, '{t}') THEN '{v}'" for t, v in RARE_ASSESSMENTS)}
  ELSE 'Needs review' END END AS assessment
 FROM (SELECT *, CASE WHEN n < total // 80 THEN 'very_rare' WHEN n < total // 18 THEN 'rare' END AS tier FROM
  (SELECT material, count(*) AS n, {_TIER_SQL} AS total FROM shares GROUP BY material) c) t WHERE tier IS NOT NULL""",
)
def a14(spark, sf):
    df = shipments(spark, sf)
    rows = df.count()
    counts = profile.material_frequency(df).select("material", "n")
    return profile.low_usage_issues(counts, [("very_rare", rows // 80), ("rare", rows // 18)])


_EXAMPLES = ["nylon", "membrane_tpu", "polyster_virgin", "silk"]


@query(
    "a14_material_examples",
    SHARES
    + f"""SELECT material, product_id, category, gender, example FROM (SELECT *, row_number() OVER
 (PARTITION BY material ORDER BY product_id) AS example FROM shares WHERE material IN {in_list(_EXAMPLES)}) t WHERE example <= 3""",
)
def a14_examples(spark, sf):
    out = profile.material_examples(shipments(spark, sf), _EXAMPLES, "product_id", ["category", "gender"])
    return with_long(out)


BANDS = {
    "weight_5": ("weight_kg", WEIGHT_BANDS_5),
    "weight_7": ("weight_kg", WEIGHT_BANDS_7),
    "weight_7_closed": ("weight_kg", WEIGHT_BANDS_7_CLOSED),
    "distance_8": ("total_distance_km", DISTANCE_BANDS_8),
    "distance_5": ("total_distance_km", DISTANCE_BANDS_5),
}


def _band_test(column, low, low_closed, high, high_closed) -> str:
    tests = []
    if low is not None:
        tests.append(f"{column} {'>=' if low_closed else '>'} {low}::DOUBLE")
    if high is not None:
        tests.append(f"{column} {'<=' if high_closed else '<'} {high}::DOUBLE")
    return " AND ".join(tests)


@query(
    "a15_band_counts",
    PLAIN
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, '{b[0]}' AS band, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM shipments)')} AS pct"
        f" FROM shipments WHERE {_band_test(column, *b[1:])} HAVING count(*) > 0"
        for kind, (column, bands) in BANDS.items()
        for b in bands
    ),
)
def a15(spark, sf):
    return rounded(profile.band_counts(shipments(spark, sf), BANDS))


@query(
    "a16_unit_error_test",
    PLAIN
    + f""", t AS (SELECT 'low' AS side, count(*) AS n, count(*) FILTER (WHERE weight_kg * 1000 BETWEEN 0.1::DOUBLE AND 5) AS n_corrected
 FROM shipments WHERE weight_kg < 0.01::DOUBLE UNION ALL
 SELECT 'high', count(*), count(*) FILTER (WHERE weight_kg / 1000 BETWEEN 0.1::DOUBLE AND 5) FROM shipments WHERE weight_kg > 10)
 SELECT side, n, n_corrected, {pct('n_corrected', 'n')} AS pct,
 CASE WHEN n_corrected * 100.0 / n > 80 THEN 'strong' WHEN n_corrected * 100.0 / n > 50 THEN 'moderate' ELSE 'unlikely' END AS verdict,
 CAST(n_corrected * 100.0 / n > 70 AS BIGINT) AS is_issue FROM t""",
)
def a16(spark, sf):
    return with_long(rounded(profile.unit_error_test(shipments(spark, sf))))


@query(
    "a17_category_weight_stats",
    PLAIN
    + f"""SELECT category, count(*) AS n, {r('avg(weight_kg)')} AS mean, {r('min(weight_kg)')} AS min, {r('max(weight_kg)')} AS max,
 {r('stddev_samp(weight_kg)')} AS std, {r('median(weight_kg)')} AS median,
 CAST(avg(weight_kg) < 0.1::DOUBLE OR avg(weight_kg) > 3 AS BIGINT) AS suspicious
 FROM shipments WHERE weight_kg IS NOT NULL GROUP BY category""",
)
def a17(spark, sf):
    return with_long(rounded(profile.category_weight_stats(shipments(spark, sf))))


def _extreme(column: str, side: str) -> str:
    order = "ASC" if side == "smallest" else "DESC"
    return f"""SELECT * FROM (SELECT '{column}' AS "column", '{side}' AS side, product_id, {column} AS value,
 {r(f'{column} / 40075.0::DOUBLE')} AS earth_ratio FROM shipments WHERE {column} IS NOT NULL ORDER BY {column} {order}, product_id LIMIT 10) t"""


@query(
    "a18_extremes",
    PLAIN
    + " UNION ALL ".join(_extreme(c, s) for c in ("weight_kg", "total_distance_km") for s in ("smallest", "largest")),
)
def a18(spark, sf):
    out = profile.extremes(shipments(spark, sf), "product_id", ["weight_kg", "total_distance_km"])
    return out.withColumn("earth_ratio", rnd("earth_ratio"))


@query(
    "a19_outlier_breakdown",
    PLAIN
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n, {r('avg(total_distance_km)')} AS mean,"
        f" row_number() OVER (ORDER BY count(*) DESC, {d}) AS rank FROM shipments WHERE total_distance_km >= 40000 GROUP BY {d}"
        for d in ("category", "manufacturer_country")
    )
    + ") t WHERE rank <= 10",
)
def a19(spark, sf):
    return with_long(rounded(profile.outlier_breakdown(shipments(spark, sf))))


EXPECTED = "expected(category, parent) AS (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in EXPECTED_PARENT.items()) + ")"


@query(
    "a20_category_parent_mismatch",
    ctes(SHIPMENTS, EXPECTED)
    + """SELECT s.category, s.parent_category, count(*) AS n, e.parent AS expected_parent,
 CASE WHEN e.parent IS NULL THEN 'orphan' ELSE 'mismatch' END AS issue
 FROM shipments s LEFT JOIN expected e ON s.category = e.category
 WHERE e.parent IS NULL OR e.parent <> s.parent_category GROUP BY s.category, s.parent_category, e.parent""",
)
def a20(spark, sf):
    return profile.category_parent_mismatch(shipments(spark, sf))


@query(
    "a21_gender_category_issues",
    PLAIN
    + f"""SELECT category, count(*) FILTER (WHERE gender = 'Male') AS n_male, count(*) AS n,
 {pct("count(*) FILTER (WHERE gender = 'Male')", 'count(*)')} AS pct FROM shipments
 WHERE category IN {in_list(TYPICALLY_FEMALE)} GROUP BY category HAVING count(*) FILTER (WHERE gender = 'Male') > 0""",
)
def a21(spark, sf):
    return rounded(profile.gender_category_issues(shipments(spark, sf)))


ISSUES = f"""material_issues AS (SELECT *, CASE WHEN parent_category <> 'Footwear' AND {names_any_sql(FOOTWEAR_ONLY)}
 THEN 'footwear_material_in_clothing' WHEN parent_category = 'Footwear' AND j IS NOT NULL AND NOT {names_any_sql(FOOTWEAR_MATERIALS)}
 THEN 'no_footwear_material_in_footwear' END AS issue FROM parsed)"""


@query(
    "a22_material_category_issues",
    ctes(SHIPMENTS, parsed(), ISSUES)
    + "SELECT issue, parent_category, category, count(*) AS n FROM material_issues WHERE issue IS NOT NULL GROUP BY ALL",
)
def a22(spark, sf):
    return profile.material_category_issues(shipments(spark, sf))


@query(
    "a23_material_combinations",
    PARSED
    + """SELECT array_to_string(list_sort(json_keys(j)), ' + ') AS combination, count(*) AS n, min(category) AS example_category
 FROM parsed WHERE j IS NOT NULL GROUP BY 1 ORDER BY n DESC, combination LIMIT 10""",
)
def a23(spark, sf):
    return profile.material_combinations(shipments(spark, sf))


VARIANTS = "variants(variant_group, category) AS (VALUES " + ", ".join(
    f"('{g}', '{n}')" for g, names in NAMING_VARIANTS.items() for n in names
) + ")"


@query(
    "a24_naming_variants",
    ctes(SHIPMENTS, VARIANTS)
    + """SELECT s.category, count(*) AS n, v.variant_group FROM shipments s JOIN variants v ON s.category = v.category GROUP BY ALL""",
)
def a24(spark, sf):
    return profile.naming_variants(shipments(spark, sf))


_ANOMALIES = {
    ("weight", "extreme_low"): "weight_kg < 0.01::DOUBLE",
    ("weight", "extreme_high"): "weight_kg > 50",
    ("weight", "zero_or_negative"): "weight_kg <= 0",
    ("weight", "missing"): "weight_kg IS NULL",
    ("distance", "extreme_low"): "total_distance_km < 1",
    ("distance", "extreme_high"): "total_distance_km > 40000",
    ("distance", "zero_or_negative"): "total_distance_km <= 0",
    ("distance", "missing"): "total_distance_km IS NULL",
}
ANOMALY_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, '{a}' AS anomaly, count(*) FILTER (WHERE {t}) AS n FROM shipments"
    for (f, a), t in _ANOMALIES.items()
)


@query("a25_numeric_anomalies", PLAIN + ANOMALY_SQL)
def a25(spark, sf):
    return profile.numeric_anomalies(shipments(spark, sf))


CLASSES = "classes(error_class, material) AS (VALUES " + ", ".join(
    f"('{c}', '{n}')" for c, names in ERROR_CLASSES.items() for n in names
) + ")"


@query(
    "a26_material_error_classes",
    ctes(SHIPMENTS, parsed(), shares(KEEP), CLASSES)
    + "SELECT error_class, count(*) AS n FROM shares s JOIN classes c ON s.material = c.material GROUP BY error_class",
)
def a26(spark, sf):
    return profile.material_error_classes(shipments(spark, sf))


@query(
    "a26_erroneous_products",
    PARSED
    + f"""SELECT *, CASE WHEN n_erroneous / n_rows::DOUBLE < 0.001 THEN 'remove' WHEN n_erroneous / n_rows::DOUBLE < 0.01 THEN 'review'
 ELSE 'investigate' END AS recommendation FROM (SELECT count(*) AS n_rows,
 count(*) FILTER (WHERE {names_any_sql(ERRONEOUS_AUDIT)}) AS n_erroneous,
 count(*) FILTER (WHERE {names_any_sql(QUESTIONABLE)}) AS n_questionable,
 count(*) FILTER (WHERE {names_any_sql(ERRONEOUS_AUDIT + QUESTIONABLE)}) AS n_combined FROM parsed) t""",
)
def a26_products(spark, sf):
    return profile.erroneous_products(shipments(spark, sf))


@query(
    "a27_issue_total",
    ctes(SHIPMENTS, parsed(), shares(KEEP), CLASSES, VARIANTS, EXPECTED, ISSUES, f"anomalies AS ({ANOMALY_SQL})")
    + f"""SELECT CAST(
 (SELECT count(*) FROM (SELECT DISTINCT s.category, s.parent_category FROM shipments s JOIN expected e ON s.category = e.category
   WHERE e.parent <> s.parent_category) t)
 + (SELECT count(DISTINCT category) FROM shipments WHERE category NOT IN (SELECT category FROM expected))
 + (SELECT count(DISTINCT category) FROM shipments WHERE category IN {in_list(TYPICALLY_FEMALE)} AND gender = 'Male')
 + (SELECT count(DISTINCT variant_group) FROM shipments s JOIN variants v ON s.category = v.category)
 + (SELECT count(*) FROM material_issues WHERE issue IS NOT NULL)
 + (SELECT sum(n) FROM anomalies)
 + (SELECT count(*) FROM shares s JOIN classes c ON s.material = c.material) AS BIGINT) AS total_issues""",
)
def a27(spark, sf):
    return profile.issue_total(shipments(spark, sf))


_M = "SELECT *, weight_kg - avg(weight_kg) OVER () AS d FROM shipments WHERE weight_kg > 0.001::DOUBLE AND weight_kg < 10"


@query(
    "a28_shape_stats",
    PLAIN
    + f""", m AS ({_M}), s AS (SELECT count(*) AS n, avg(log10(weight_kg)) AS lm, stddev_samp(log10(weight_kg)) AS ls,
 avg(d * d * d) / pow(avg(d * d), 1.5::DOUBLE) AS sk, avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3 AS ku FROM m)
 SELECT n, {r('lm')} AS log10_mean, {r('ls')} AS log10_std, {r('sk')} AS skewness, {r('ku')} AS kurtosis,
 {r('n / 6.0::DOUBLE * (sk * sk + ku * ku / 4)', 3)} AS jarque_bera,
 CAST(n / 6.0::DOUBLE * (sk * sk + ku * ku / 4) < 5.991::DOUBLE AS BIGINT) AS is_normal FROM s""",
)
def a28(spark, sf):
    out = profile.shape_stats(shipments(spark, sf))
    six = ["log10_mean", "log10_std", "skewness", "kurtosis"]
    return with_long(out.withColumns({c: rnd(c) for c in six} | {"jarque_bera": rnd("jarque_bera", 3)}))


@query(
    "a29_before_after",
    ctes(SHIPMENTS, final_shipments())
    + """, b AS (SELECT category, count(*) AS n FROM shipments GROUP BY category), a AS (SELECT CASE WHEN category = 'Gowns' THEN
 'Evening Gowns' ELSE category END AS category, count(*) AS n FROM cleaned GROUP BY 1)
 SELECT coalesce(b.category, a.category) AS category, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after,
 coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM b FULL OUTER JOIN a ON b.category = a.category""",
)
def a29(spark, sf):
    """Raw against cleaned shipments; one category is renamed so that both sides lack a value."""
    before = shipments(spark, sf)
    after = build_final_dataset(before).where(F.col("total_distance_km") <= 40000)
    renamed = F.when(F.col("category") == "Gowns", "Evening Gowns").otherwise(F.col("category"))
    return profile.before_after(before.select("category"), after.select(renamed.alias("category")))


@query(
    "a30_histogram",
    PLAIN
    + f""", s AS (SELECT min(total_distance_km) AS lo, (max(total_distance_km) - min(total_distance_km)) / 50 AS w FROM shipments)
 SELECT bin, {r('lo + bin * w')} AS low, {r('lo + (bin + 1) * w')} AS high, count(*) AS n FROM
 (SELECT CAST(least(floor((total_distance_km - lo) / w), 49) AS BIGINT) AS bin, lo, w FROM shipments, s
  WHERE total_distance_km IS NOT NULL) t GROUP BY bin, lo, w""",
)
def a30(spark, sf):
    return rounded(profile.histogram(shipments(spark, sf), "total_distance_km", 50))


@query(
    "a31_rank_trend",
    PLAIN
    + f"""SELECT count(*) AS n_values, {r('regr_slope(n::DOUBLE, rank::DOUBLE)')} AS slope,
 {r('regr_intercept(n::DOUBLE, rank::DOUBLE)')} AS intercept FROM
 (SELECT manufacturer_country, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, manufacturer_country) - 1 AS rank
  FROM shipments GROUP BY manufacturer_country) t WHERE rank < 50""",
)
def a31(spark, sf):
    return rounded(profile.rank_trend(shipments(spark, sf)))


@query(
    "a32_material_heatmap",
    SHARES
    + f""", tc AS (SELECT category FROM shipments GROUP BY category ORDER BY count(*) DESC, category LIMIT 15),
 tm AS (SELECT material FROM shares GROUP BY material ORDER BY count(*) DESC, material LIMIT 20)
 SELECT category, material, count(*) AS n, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY category)')} AS pct FROM shares
 WHERE category IN (SELECT category FROM tc) AND material IN (SELECT material FROM tm) GROUP BY category, material""",
)
def a32(spark, sf):
    return rounded(profile.material_heatmap(shipments(spark, sf)))


@query("a33_pca_spread")
def a33(spark, sf):
    return profile.pca_spread(shipments(spark, sf), keep=["product_id"])


_AXES = ["n0", "n1", "g", *[f"p{i}" for i in range(len(PARENTS))]]
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _first_axis(name: str, matrix: str, steps: int = 24) -> str:
    """CTEs with the first eigenvector (``v``, largest loading positive) and value of a covariance matrix.

    The matrix is squared again and again, so that close eigenvalues are told apart too.
    """
    size = len(_AXES)
    start = "[" + ", ".join(f"{1 + i / 10}::DOUBLE" for i in range(size)) + "]"
    squared = f"list_transform(c, lambda a: list_transform(range(1, {size + 1}), lambda j: {_DOT.format(a='a', b='c[j]')}))"
    trace = f"list_sum(list_transform(range(1, {size + 1}), lambda i: w[i][i]))"
    times = lambda v: "list_transform(c, lambda a: " + _DOT.format(a="a", b=v) + ")"
    return f"""{name}_it AS (SELECT 0 AS step, c FROM {matrix}
 UNION ALL SELECT step + 1, list_transform(w, lambda a: list_transform(a, lambda x: x / t))
 FROM (SELECT step, w, {trace} AS t FROM (SELECT step, {squared} AS w FROM {name}_it WHERE step < {steps}) p) q),
{name}_v AS MATERIALIZED (SELECT list_transform(v, lambda x: x * sign(v[list_position(b, list_max(b))])) AS v FROM
 (SELECT v, list_transform(v, lambda x: round(abs(x), 9)) AS b FROM
  (SELECT list_transform(w, lambda x: x / sqrt({_DOT.format(a='w', b='w')})) AS v FROM
   (SELECT {times(start)} AS w FROM {name}_it WHERE step = {steps}) p) q) u),
{name} AS MATERIALIZED (SELECT v, {_DOT.format(a='v', b=times('v'))} AS value FROM {name}_v, {matrix})"""


@query(
    "a33_pca_summary",
    "WITH RECURSIVE "
    + SHIPMENTS
    + f""", known AS (SELECT weight_kg, total_distance_km, CASE {case_map('gender', GENDER_RECODE)} WHEN 'Male' THEN 0.0::DOUBLE
  WHEN 'Female' THEN 1 END AS g0, parent_category FROM shipments),
 m AS (SELECT avg(weight_kg) AS a0, stddev_pop(weight_kg) AS s0, avg(total_distance_km) AS a1, stddev_pop(total_distance_km) AS s1
  FROM known WHERE g0 IS NOT NULL AND parent_category IN {in_list(PARENTS)} AND weight_kg IS NOT NULL AND total_distance_km IS NOT NULL),
 x AS MATERIALIZED (SELECT (weight_kg - a0) / s0 AS n0, (total_distance_km - a1) / s1 AS n1, g0 AS g,
  {', '.join(f"CAST(parent_category = '{p}' AS INT)::DOUBLE AS p{i}" for i, p in enumerate(PARENTS))}
  FROM known, m WHERE g0 IS NOT NULL AND parent_category IN {in_list(PARENTS)} AND weight_kg IS NOT NULL AND total_distance_km IS NOT NULL),
 cov AS MATERIALIZED (SELECT [{', '.join('[' + ', '.join(f'covar_samp({a}, {b})' for b in _AXES) + ']' for a in _AXES)}] AS c FROM x),
 {_first_axis('axis_1', 'cov')},
 rest AS MATERIALIZED (SELECT list_transform(range(1, {len(_AXES) + 1}), lambda i: list_transform(range(1, {len(_AXES) + 1}),
  lambda j: c[i][j] - value * v[i] * v[j])) AS c FROM cov, axis_1),
 {_first_axis('axis_2', 'rest')}
 SELECT (SELECT count(*) FROM x) AS n, {r('f.value')} AS variance_1, {r('s.value')} AS variance_2, 0.0::DOUBLE AS mean_1,
 0.0::DOUBLE AS mean_2, 0.0::DOUBLE AS correlation, {r('f.v[1]')} AS weight_1, {r('s.v[1]')} AS weight_2, {r('f.v[2]')} AS distance_1,
 {r('s.v[2]')} AS distance_2 FROM axis_1 f, axis_2 s""",
)
def a33_summary(spark, sf):
    """Variances, means and correlation of the components and their loadings on the numbers."""
    spread = profile.pca_spread(shipments(spark, sf), keep=["weight_kg", "total_distance_km"])

    def loading(pc: str, column: str):
        return F.covar_samp(pc, column) / F.stddev_pop(column) / F.var_samp(pc)

    numbers = (("weight", "weight_kg"), ("distance", "total_distance_km"))
    out = spread.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.var_samp(f"pc{i}").alias(f"variance_{i}") for i in (1, 2)],
        *[F.avg(f"pc{i}").alias(f"mean_{i}") for i in (1, 2)],
        F.corr("pc1", "pc2").alias("correlation"),
        *[loading(f"pc{i}", c).alias(f"{n}_{i}") for n, c in numbers for i in (1, 2)],
    )
    return rounded(out)
