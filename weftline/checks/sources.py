"""Queries of the source and sink group.

Files are derived from the given tables, written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.checks.registry import (
    SHIPMENTS,
    SHIPMENTS_FP,
    ctes,
    parsed,
    query,
    r,
    rnd,
    shares,
    shipments_fp,
)
from weftline.constants import MATERIALS
from weftline.operators import compose, profile
from weftline.operators.clean import null_profile
from weftline.schema import PRODUCT_COLUMNS, SPLIT_COLUMNS, TARGETS
from weftline.session import scratch_path
from weftline.sources import products
from weftline.sources.shipments import shipments, table

PLAIN = ctes(SHIPMENTS)
COLS = ", ".join(PRODUCT_COLUMNS)


@query(
    "s1_read_products",
    PLAIN
    + f"""SELECT {COLS}, CAST(NULL AS VARCHAR) AS reject FROM shipments WHERE category <> 'Coats'
 UNION ALL SELECT {', '.join('NULL' for _ in PRODUCT_COLUMNS)}, '"' || product_name || '","' || gender || '"'
 FROM shipments WHERE category = 'Coats'""",
)
def s1(spark, sf):
    """Lines of one category are cut after two fields and have to come back as rejects."""
    path = scratch_path(spark, "products-csv")
    line = F.when(F.col("category") == "Coats", products.csv_line(["product_name", "gender"])).otherwise(
        products.csv_line(PRODUCT_COLUMNS)
    )
    shipments(spark, sf).select(line.alias("value")).write.text(path)
    rows, rejects = products.read_products(spark, path, header=False)
    return rows.withColumn("reject", F.lit(None).cast("string")).unionByName(
        rejects.select(F.col("line").alias("reject")), allowMissingColumns=True
    )


@query(
    "s2_read_material_factors",
    """SELECT p_brand || '/' || p_type AS material,
 arg_min(p_retailprice, p_partkey) FILTER (WHERE p_partkey % 5 <> 0) AS carbon,
 arg_min(p_size::DOUBLE, p_partkey) FILTER (WHERE p_partkey % 3 <> 0) AS water FROM part GROUP BY 1""",
)
def s2(spark, sf):
    """Parts as factor rows: names repeat, and carbon or water are sometimes empty."""
    path = scratch_path(spark, "factors-csv")
    fields = {i: F.lit("x") for i in range(11)}
    fields[0] = F.concat_ws("/", "p_brand", "p_type")
    fields[1] = F.col("p_partkey").cast("string")
    fields[7] = F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice").cast("string")).otherwise("")
    fields[10] = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")).otherwise("")
    table(spark, sf, "part").select(*[e.alias(f"f{i}") for i, e in fields.items()]).write.option("header", "true").csv(path)
    return products.read_material_factors(spark, path, order_position=1)


@query(
    "s3_read_mode_params",
    f"""WITH u AS (SELECT p_type, 'beta0' AS param, avg(l_discount) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
 UNION ALL SELECT p_type, 'beta1', avg(l_tax) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'SMALL' GROUP BY ALL),
 f AS (SELECT p_type, avg(p_retailprice) - CASE WHEN p_type = 'MEDIUM' THEN 1e9 ELSE 0 END AS ef FROM part GROUP BY p_type)
 SELECT lower(f.p_type) AS mode, {r('ef')} AS ef,
 {r("coalesce((SELECT value FROM u WHERE u.p_type = f.p_type AND param = 'beta0'), 0)")} AS beta0,
 {r("coalesce((SELECT value FROM u WHERE u.p_type = f.p_type AND param = 'beta1'), 0)")} AS beta1
 FROM f WHERE ef > 0 AND p_type <> 'LARGE'""",
)
def s3(spark, sf):
    """Part types as modes in mixed spelling: one unknown, one not positive, one without a slope."""
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    kind = F.col("p_type")
    factors = part.groupBy("p_type").agg(F.avg("p_retailprice").alias("ef"))
    factors = factors.select(
        F.concat(F.lit(" "), kind).alias("mode"),
        F.when(kind == "MEDIUM", F.col("ef") - 1e9).otherwise(F.col("ef")).alias("ef"),
    )
    means = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type")
    means = means.agg(F.avg("l_discount").alias("beta0"), F.avg("l_tax").alias("beta1"))
    utility = means.unpivot(["p_type"], ["beta0", "beta1"], "param", "value").where(
        ~((kind == "SMALL") & (F.col("param") == "beta1"))
    )
    paths = scratch_path(spark, "mode-factors"), scratch_path(spark, "mode-utility")
    factors.write.option("header", "true").csv(paths[0])
    utility.select(F.initcap(kind).alias("mode"), F.upper("param").alias("param"), "value").write.option(
        "header", "true"
    ).csv(paths[1])
    modes, _ = products.read_mode_params(spark, *paths, ["SMALL", "MEDIUM", "STANDARD", "ECONOMY", "PROMO"])
    return modes.select("mode", *[rnd(c).alias(c) for c in ("ef", "beta0", "beta1")])


def split_table(spark, sf) -> DataFrame:
    """Cleaned shipments with outputs and share columns, plus the row key."""
    wide = compose.pivot_materials(compose.with_composition(shipments_fp(spark, sf)))
    return wide.select("product_id", *SPLIT_COLUMNS)


@query(
    "s4_read_split",
    SHIPMENTS_FP.rstrip()
    + ",\n"
    + parsed("fp", "fpj")
    + ",\n"
    + shares("product_id", "fpj", "fps")
    + f""" SELECT fp.product_id, product_name, gender, parent_category, category, manufacturer_country, weight_kg, total_distance_km,
 {', '.join(f'{r(t)} AS {t}' for t in TARGETS)}, {', '.join(f'coalesce(w.{m}, 0::DOUBLE) AS {m}' for m in MATERIALS)}
 FROM fp LEFT JOIN (SELECT product_id, {', '.join(f"max(share) FILTER (WHERE material = '{m}') AS {m}" for m in MATERIALS)}
 FROM fps GROUP BY product_id) w ON fp.product_id = w.product_id""",
)
def s4(spark, sf):
    path = scratch_path(spark, "split")
    split_table(spark, sf).write.parquet(path)
    return products.read_split(spark, path).withColumns({t: rnd(t) for t in TARGETS})


@query(
    "s5_category_hierarchy",
    """SELECT r_name AS gender, n_name AS parent_category, s_name AS category, r_name || ' > ' || n_name || ' > ' || s_name AS full_path
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name, n_name, n_name, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
 WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""",
)
def s5(spark, sf):
    """Regions, nations and suppliers as the three levels, written and read as JSON."""
    empty = F.lit(None).cast("string")
    region = table(spark, sf, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), empty.alias("parent_id")
    )
    nation = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent_id"),
    )
    supplier = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("n"), "s_nationkey").alias("parent_id"),
    )
    return products.category_hierarchy(region.unionByName(nation).unionByName(supplier))


@query(
    "s6_write_products",
    SHIPMENTS_FP + f"SELECT product_id, {COLS}, {', '.join(f'{r(t)} AS {t}' for t in TARGETS)} FROM fp",
)
def s6(spark, sf):
    path = scratch_path(spark, "footprints-csv")
    columns = ["product_id", *PRODUCT_COLUMNS, *TARGETS]
    done = shipments_fp(spark, sf).select(*columns).withColumns({t: rnd(t) for t in TARGETS})
    products.write_products(done, path, fmt="csv")
    rows, _ = products.read_products(spark, path, columns, ["weight_kg", "total_distance_km", *TARGETS])
    return rows


@query(
    "s7_write_report",
    PLAIN
    + "SELECT 'overview' AS section, * FROM (SELECT 'n_rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM shipments"
    + "".join(
        f" UNION ALL SELECT 'n_{d}', CAST(count(DISTINCT {d}) AS VARCHAR) FROM shipments" for d in profile.DIMENSIONS
    )
    + ") a UNION ALL SELECT 'nulls', * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}.n_null', CAST(count(*) FILTER (WHERE {c} IS NULL) AS VARCHAR) FROM shipments" for c in PRODUCT_COLUMNS
    )
    + ") b",
)
def s7(spark, sf):
    df = shipments(spark, sf)
    nulls = null_profile(df, PRODUCT_COLUMNS).where(F.col("column") != "*").select("column", "n_null")
    return products.write_report(
        {"overview": (profile.overview(df), None), "nulls": (nulls, "column")}, scratch_path(spark, "report")
    )


def raw_lines(spark, sf) -> DataFrame:
    """Shipments as generated text with prose, headers, blank and short lines in between."""
    good = shipments(spark, sf).select(F.concat(F.lit("  "), products.csv_line(PRODUCT_COLUMNS)).alias("value"))
    name = F.col("p_name")
    noise = F.array(
        F.lit(""),
        F.concat(F.lit("Here are some products, like "), name),
        F.concat(F.lit("NOTE: "), name, F.lit(", as asked")),
        F.concat(F.lit("no separator "), name),
        F.concat(F.lit('"'), name, F.lit('","Male"')),
        F.lit(",".join(PRODUCT_COLUMNS)),
    )
    return good.unionByName(table(spark, sf, "part").select(F.explode(noise).alias("value")))


@query("s8_parse_generated_lines", PLAIN + f"SELECT {COLS} FROM shipments")
def s8(spark, sf):
    return products.parse_generated_lines(raw_lines(spark, sf))
