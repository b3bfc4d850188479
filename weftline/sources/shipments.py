"""Adapter: a product table with planted defects, derived from the order tables.

The join keys are the tables' own keys; no hints are given, so small sides are broadcast by
their measured size and large ones are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.constants import MATERIALS, MODES
from weftline.functions.columns import literal_array, once, values_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that comes as fewer splits than there are cores.

    Only a small file does; a large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _choose(col, options: dict, default):
    expr = None
    for key, value in options.items():
        expr = F.when(col == key, value) if expr is None else expr.when(col == key, value)
    return expr.otherwise(default)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as products: id, the eight product columns, defects included."""
    line = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
        )
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    key, part_key, size = F.col("l_orderkey"), F.col("l_partkey"), F.col("p_size")
    names = literal_array(MATERIALS)
    first = (
        F.when(part_key % 97 == 0, "polyster_virgin")
        .when(part_key % 89 == 0, "nylon")
        .when(part_key % 83 == 0, "membrane_tpu")
        .otherwise(F.get(names, (part_key % 34).cast("int")))
    )
    second = F.get(names, ((part_key * 7 + 5) % 34).cast("int"))
    share = F.lit(50) + F.col("l_linenumber") * 5
    rest = F.lit(100) - share
    named = joined.withColumns({"m1": first, "m2": second})
    m1, m2 = F.col("m1"), F.col("m2")
    maxi = size == 50
    category = {
        "SMALL": _choose(size % 4, {0: "Polos", 1: "Hoodies", 2: "Sweatshirts & Hoodies"}, "Blouses"),
        "ECONOMY": _choose(size % 4, {0: "Jeans", 1: "Denim Pants", 2: "Sweatpants"}, "Maxi Skirts"),
        "STANDARD": _choose(size % 3, {0: "Parkas", 1: "Denem Jackets"}, "Coats"),
        "MEDIUM": _choose(size % 3, {0: "Sneakers", 1: "Boots"}, "Sandwear"),
        "LARGE": _choose(size % 4, {0: "Maxi", 1: "Midi Dresses", 2: "Gowns"}, "Dresses"),
    }
    parent = {
        "SMALL": "Tops",
        "ECONOMY": "Bottoms",
        "STANDARD": "Outerwear",
        "MEDIUM": "Footwear",
        "LARGE": "Dresses",
    }
    return named.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.when(F.col("l_returnflag") == "A", "Male")
        .when(F.col("l_returnflag") == "R", "Female")
        .when(F.col("l_linenumber") % 2 == 0, "Men's")
        .otherwise("Women's")
        .alias("gender"),
        _choose(F.col("p_type"), parent, F.when(maxi, "Maxi").otherwise("Tops")).alias("parent_category"),
        _choose(F.col("p_type"), category, F.when(maxi, "Maxi").otherwise("Jerseys")).alias("category"),
        F.col("n_name").alias("manufacturer_country"),
        once(
            F.when(part_key % 79 == 0, None)
            .when(part_key % 73 == 0, "not json")
            .when(part_key % 71 == 0, F.concat(F.lit("{'"), m1, F.lit("': 1.0}")))
            .when(m1 == m2, F.concat(F.lit('{"'), m1, F.lit('": 1.0}')))
            .otherwise(
                F.concat(
                    F.lit('{"'), m1, F.lit('": 0.'), share.cast("string"), F.lit(', "'), m2, F.lit('": 0.'),
                    F.when(rest < 10, "0").otherwise(""), rest.cast("string"), F.lit("}"),
                )
            )
        )
        .alias("materials"),
        F.when(key % 53 == 0, None)
        .when(key % 211 == 0, F.col("l_quantity") * size)
        .otherwise(F.col("l_quantity") * size / 1000.0)
        .alias("weight_kg"),
        F.when(key % 47 == 0, None)
        .otherwise(F.round(F.col("l_extendedprice") * 0.4, 2))
        .alias("total_distance_km"),
    )


def demo_factors(spark: SparkSession) -> DataFrame:
    """Synthetic factors for the vocabulary: (material, carbon, water); 34 rows."""
    rows = [(m, 0.5 + i * 0.75, 30.0 + i * 137.0) for i, m in enumerate(MATERIALS)]
    return values_table(spark, rows, ["material", "carbon", "water"])


def demo_modes(spark: SparkSession) -> DataFrame:
    """The five freight modes with their utility parameters."""
    return values_table(spark, MODES, ["mode", "ef", "beta0", "beta1"])
