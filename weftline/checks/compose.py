"""Queries of the composition group."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.checks.registry import SHIPMENTS, ctes, in_list, parsed, query, r, rnd, shares, with_long
from weftline.constants import ALIASES, MATERIALS
from weftline.operators import compose
from weftline.sources.shipments import shipments

PARSED = ctes(SHIPMENTS, parsed())
SHARES = ctes(SHIPMENTS, parsed(), shares("product_id"))


@query(
    "p1_parse_materials",
    PARSED
    + """SELECT product_id, CASE WHEN j IS NULL THEN 0 ELSE 1 END AS is_parsed,
 coalesce(array_to_string(list_sort(json_keys(j)), ','), '') AS names FROM parsed""",
)
def p1(spark, sf):
    df = compose.with_composition(shipments(spark, sf))
    comp = F.col("composition")
    return df.select(
        "product_id",
        comp.isNotNull().cast("int").alias("is_parsed"),
        F.coalesce(F.array_join(F.array_sort(F.map_keys(comp)), ","), F.lit("")).alias("names"),
    )


@query("p2_explode_materials", SHARES + "SELECT product_id, material, share FROM shares")
def p2(spark, sf):
    return compose.explode_materials(compose.with_composition(shipments(spark, sf)), ["product_id"])


@query(
    "p3_pivot_materials",
    SHARES
    + "SELECT p.product_id, "
    + ", ".join(f"coalesce(max(CASE WHEN s.material = '{m}' THEN s.share END), 0::DOUBLE) AS {m}" for m in MATERIALS)
    + " FROM parsed p LEFT JOIN shares s ON p.product_id = s.product_id GROUP BY p.product_id",
)
def p3(spark, sf):
    df = compose.with_composition(shipments(spark, sf))
    return compose.pivot_materials(df).select("product_id", *MATERIALS)


@query(
    "p4_unpivot_materials",
    SHARES + f"SELECT product_id, material, share FROM shares WHERE share <> 0 AND material IN {in_list(MATERIALS)}",
)
def p4(spark, sf):
    wide = compose.pivot_materials(compose.with_composition(shipments(spark, sf)))
    return compose.unpivot_materials(wide, ["product_id"])


@query(
    "p5_composition_check",
    SHARES
    + f"""SELECT product_id, {r('sum(share)')} AS share_sum,
 CAST(min(CASE WHEN share BETWEEN 0 AND 1 THEN 1 ELSE 0 END) AS BIGINT) AS shares_in_range,
 CAST(CASE WHEN abs(sum(share) - 1) <= 0.01::DOUBLE THEN 1 ELSE 0 END AS BIGINT) AS sum_ok,
 CAST(max(CASE WHEN material IN {in_list(MATERIALS)} THEN 0 ELSE 1 END) AS BIGINT) AS has_unknown,
 {r(f'sum(CASE WHEN material IN {in_list(MATERIALS)} THEN 0::DOUBLE ELSE share END)')} AS unknown_share
 FROM shares GROUP BY product_id""",
)
def p5(spark, sf):
    df = compose.with_composition(shipments(spark, sf)).where(F.col("composition").isNotNull())
    checked = compose.composition_check(df)
    return with_long(
        checked.select(
            "product_id",
            rnd("share_sum").alias("share_sum"),
            "shares_in_range",
            "sum_ok",
            "has_unknown",
            rnd("unknown_share").alias("unknown_share"),
        )
    )


# the names of the test data are written in mixed case with blanks and as an alias of themselves
_LOUD = {"cotton_conventional": " Cotton ", "elastane": "SPANDEX", "viscose": "Viscose", "silk": " SILK"}


@query(
    "p6_normalise_aliases",
    SHARES
    + "SELECT product_id, CASE material "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())
    + """ ELSE material END AS material, arg_max(share, pos) AS share
 FROM (SELECT product_id, k AS material, json_extract(j, '$.' || k)::DOUBLE AS share, pos FROM
   (SELECT product_id, j, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS pos
    FROM parsed WHERE j IS NOT NULL) a) b
 GROUP BY ALL""",
)
def p6(spark, sf):
    df = compose.with_composition(shipments(spark, sf))
    loud = compose.rename_keys(F.col("composition"), _LOUD)
    return compose.explode_materials(
        df.withColumn("composition", compose.normalise_aliases(loud)), ["product_id"]
    )


@query(
    "p7_material_diversity",
    SHARES
    + f"""SELECT product_id, CAST(count(*) FILTER (WHERE share > 0) AS BIGINT) AS n_materials,
 {r('sum(CASE WHEN share > 0 THEN -share * ln(share + 1e-10) ELSE 0 END)')} AS entropy
 FROM shares GROUP BY product_id""",
)
def p7(spark, sf):
    df = compose.with_composition(shipments(spark, sf)).where(F.col("composition").isNotNull())
    out = df.select("product_id", *[c.alias(n) for n, c in compose.material_diversity(F.col("composition")).items()])
    return with_long(out.withColumn("entropy", rnd("entropy")))
