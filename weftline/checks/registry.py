"""Registration of queries and the SQL pieces their counterparts share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.constants import MATERIALS, MODES
from weftline.operators.emissions import FactorTable, ModeTable, product_footprint
from weftline.session import limit_methods
from weftline.sources.shipments import demo_factors, demo_modes, shipments

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            limit_methods(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = (run, sql)
        return fn

    return register


# Numbers are compared after rounding. The added 0.5001 (not 0.5) sends exact ties the same
# way in both engines even when the last bit of a sum differs.


def rnd(value, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5001)) / F.lit(scale)


def r(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5001::DOUBLE) / 1e{digits})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.withColumns({c: rnd(c, digits) for c, t in df.dtypes if t == "double"})


def with_long(df: DataFrame) -> DataFrame:
    """Flags and counts as bigint, so both engines return one integer type."""
    return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t in ("boolean", "int")})


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def case_map(column: str, mapping: dict[str, str]) -> str:
    quoted = {k.replace("'", "''"): v.replace("'", "''") for k, v in mapping.items()}
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items()) + f" ELSE {column} END"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


VOCAB = "vocab(idx, material) AS (VALUES " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(MATERIALS)) + ")"
SHIPMENTS = (
    VOCAB
    + """,
base AS (
 SELECT l.*, p.p_name, p.p_type, p.p_size, n.n_name, 50 + l.l_linenumber * 5 AS pct1
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
 JOIN supplier s ON l.l_suppkey = s.s_suppkey
 JOIN nation n ON s.s_nationkey = n.n_nationkey),
named AS (
 SELECT b.*,
  CASE WHEN b.l_partkey % 97 = 0 THEN 'polyster_virgin'
       WHEN b.l_partkey % 89 = 0 THEN 'nylon'
       WHEN b.l_partkey % 83 = 0 THEN 'membrane_tpu' ELSE v1.material END AS m1,
  v2.material AS m2
 FROM base b JOIN vocab v1 ON v1.idx = b.l_partkey % 34
             JOIN vocab v2 ON v2.idx = (b.l_partkey * 7 + 5) % 34),
shipments AS MATERIALIZED (SELECT
 concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
           CAST(l_linenumber AS VARCHAR)) AS product_id,
 p_name AS product_name,
 CASE WHEN l_returnflag = 'A' THEN 'Male' WHEN l_returnflag = 'R' THEN 'Female'
      WHEN l_linenumber % 2 = 0 THEN 'Men''s' ELSE 'Women''s' END AS gender,
 CASE p_type WHEN 'SMALL' THEN 'Tops' WHEN 'ECONOMY' THEN 'Bottoms' WHEN 'STANDARD' THEN 'Outerwear'
             WHEN 'MEDIUM' THEN 'Footwear' WHEN 'LARGE' THEN 'Dresses'
             ELSE CASE WHEN p_size = 50 THEN 'Maxi' ELSE 'Tops' END END AS parent_category,
 CASE p_type
  WHEN 'SMALL' THEN CASE p_size % 4 WHEN 0 THEN 'Polos' WHEN 1 THEN 'Hoodies'
                    WHEN 2 THEN 'Sweatshirts & Hoodies' ELSE 'Blouses' END
  WHEN 'ECONOMY' THEN CASE p_size % 4 WHEN 0 THEN 'Jeans' WHEN 1 THEN 'Denim Pants'
                      WHEN 2 THEN 'Sweatpants' ELSE 'Maxi Skirts' END
  WHEN 'STANDARD' THEN CASE p_size % 3 WHEN 0 THEN 'Parkas' WHEN 1 THEN 'Denem Jackets' ELSE 'Coats' END
  WHEN 'MEDIUM' THEN CASE p_size % 3 WHEN 0 THEN 'Sneakers' WHEN 1 THEN 'Boots' ELSE 'Sandwear' END
  WHEN 'LARGE' THEN CASE p_size % 4 WHEN 0 THEN 'Maxi' WHEN 1 THEN 'Midi Dresses'
                    WHEN 2 THEN 'Gowns' ELSE 'Dresses' END
  ELSE CASE WHEN p_size = 50 THEN 'Maxi' ELSE 'Jerseys' END END AS category,
 n_name AS manufacturer_country,
 CASE WHEN l_partkey % 79 = 0 THEN NULL
      WHEN l_partkey % 73 = 0 THEN 'not json'
      WHEN l_partkey % 71 = 0 THEN concat('{''', m1, ''': 1.0}')
      WHEN m1 = m2 THEN concat('{"', m1, '": 1.0}')
      ELSE concat('{"', m1, '": 0.', CAST(pct1 AS VARCHAR), ', "', m2, '": 0.',
                  CASE WHEN 100 - pct1 < 10 THEN '0' ELSE '' END, CAST(100 - pct1 AS VARCHAR), '}') END AS materials,
 CASE WHEN l_orderkey % 53 = 0 THEN NULL
      WHEN l_orderkey % 211 = 0 THEN l_quantity * p_size
      ELSE l_quantity * p_size / CAST(1000 AS DOUBLE) END AS weight_kg,
 CASE WHEN l_orderkey % 47 = 0 THEN NULL
      ELSE round(l_extendedprice * CAST(0.4 AS DOUBLE), 2) END AS total_distance_km
FROM named)"""
)
PRODUCT_SQL_COLUMNS = (
    "product_name, gender, parent_category, category, manufacturer_country, materials, weight_kg, total_distance_km"
)
FACTORS = """factors AS (SELECT material, CAST(0.5 AS DOUBLE) + idx * CAST(0.75 AS DOUBLE) AS carbon,
 CAST(30 + idx * 137 AS DOUBLE) AS water FROM vocab)"""


def modes_sql() -> str:
    rows = ", ".join(
        f"('{m}', CAST({ef} AS DOUBLE), CAST({b0} AS DOUBLE), CAST({b1} AS DOUBLE))" for m, ef, b0, b1 in MODES
    )
    return f"modes(mode, ef, beta0, beta1) AS (VALUES {rows})"


def parsed(source: str = "shipments", name: str = "parsed") -> str:
    """CTE with the repaired JSON text ``j``, NULL when it does not parse."""
    return f"""{name} AS (SELECT *, CASE WHEN json_valid(replace(materials, '''', '"'))
 THEN replace(materials, '''', '"') END AS j FROM {source})"""


def shares(keep: str, source: str = "parsed", name: str = "shares") -> str:
    """CTE with one row per (product, material, share)."""
    return f"""{name} AS (SELECT {keep}, k AS material, json_extract(j, '$.' || k)::DOUBLE AS share
 FROM (SELECT *, unnest(json_keys(j)) AS k FROM {source} WHERE j IS NOT NULL) u)"""


def names_any_sql(values, json_column: str = "j") -> str:
    return f"coalesce(list_has_any(json_keys({json_column}), [{', '.join(chr(39) + v + chr(39) for v in values)}]), false)"


def split_terms(distance: str = "total_distance_km") -> dict[str, str]:
    """Probability expression per mode."""
    u = {m: f"({b0}::DOUBLE + {b1}::DOUBLE * ln({distance}))" for m, _, b0, b1 in MODES}
    top = f"greatest({', '.join(u.values())})"
    whole = " + ".join(f"exp({x} - {top})" for x in u.values())
    return {m: f"CASE WHEN {distance} > 0 THEN exp({x} - {top}) / ({whole}) END" for m, x in u.items()}


def weighted_ef(distance: str = "total_distance_km") -> str:
    terms = split_terms(distance)
    return "(" + " + ".join(f"({terms[m]}) * {ef}::DOUBLE" for m, ef, _, _ in MODES) + ")"


def footprints(source: str, name: str = "fp") -> str:
    """CTEs that compute the four outputs for ``source`` (which needs product_id)."""
    return f"""{parsed(source, name + '_p')},
{shares('product_id, weight_kg', name + '_p', name + '_s')},
{name}_m AS MATERIALIZED (SELECT s.product_id, sum(s.weight_kg * s.share * coalesce(f.carbon, 0)) AS c,
  sum(s.weight_kg * s.share * coalesce(f.water, 0)) AS w
  FROM {name}_s s LEFT JOIN factors f ON s.material = f.material GROUP BY s.product_id),
{name}_0 AS (SELECT p.* EXCLUDE (j),
  CASE WHEN p.weight_kg IS NOT NULL THEN coalesce(m.c, 0) END AS carbon_material,
  CASE WHEN p.weight_kg > 0 AND p.total_distance_km > 0
       THEN p.weight_kg / 1000 * p.total_distance_km * {weighted_ef('p.total_distance_km')} / 1000
       ELSE 0 END AS carbon_transport,
  CASE WHEN p.weight_kg IS NOT NULL THEN coalesce(m.w, 0) END AS water_total
  FROM {name}_p p LEFT JOIN {name}_m m ON p.product_id = m.product_id WHERE p.materials IS NOT NULL),
{name} AS MATERIALIZED (SELECT *, carbon_material + carbon_transport AS carbon_total FROM {name}_0)"""


def final_shipments(source: str = "shipments", name: str = "cleaned") -> str:
    """CTEs for: bad materials out, mismatched pair out, units repaired, distance outliers out."""
    from weftline.constants import ERRONEOUS_FINAL

    return f"""{parsed(source, name + '_q')},
{name}_u AS (SELECT * EXCLUDE (j, weight_kg), CASE WHEN weight_kg < 0.01::DOUBLE THEN weight_kg * 1000 ELSE weight_kg END AS w0
  FROM {name}_q WHERE NOT {names_any_sql(ERRONEOUS_FINAL)}
  AND NOT (category = 'Maxi' AND parent_category = 'Maxi')),
{name} AS (SELECT * EXCLUDE (w0), CASE WHEN w0 > 10 THEN w0 / 1000 ELSE w0 END AS weight_kg
  FROM {name}_u WHERE total_distance_km <= 40000)"""


SHIPMENTS_FP = ctes(SHIPMENTS, FACTORS, final_shipments(), footprints("cleaned"))


def factor_table(spark: SparkSession) -> FactorTable:
    return FactorTable(demo_factors(spark))


def mode_table(spark: SparkSession) -> ModeTable:
    return ModeTable(demo_modes(spark))


def shipments_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned shipments with their four outputs."""
    from weftline.operators.clean import drop_distance_outliers
    from weftline.plans.cleanup import build_final_dataset

    cleaned = drop_distance_outliers(build_final_dataset(shipments(spark, sf_dir)))
    return product_footprint(cleaned, factor_table(spark), mode_table(spark))
