"""The two cleaning recipes as single lazy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.constants import ERRONEOUS_AUDIT, ERRONEOUS_FINAL, IMPOSSIBLE_MATERIALS
from weftline.operators import clean
from weftline.operators.compose import text_names_any


def build_final_dataset(df: DataFrame) -> DataFrame:
    """Drop bad materials and the mismatched pair, then repair weight units."""
    kept = clean.drop_erroneous_materials(df, ERRONEOUS_FINAL)
    kept = clean.drop_category_parent_mismatch(kept)
    return clean.fix_weight_units(kept)


def final_dataset_verification(df: DataFrame) -> DataFrame:
    """What the finished table has to show: no bad materials, pairs or weights left."""
    bad = text_names_any(F.col("materials"), ERRONEOUS_FINAL)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("bad_materials"),
        F.count_if((F.col("category") == "Maxi") & (F.col("parent_category") == "Maxi")).alias("bad_pairs"),
        F.count_if(F.col("weight_kg") < 0.01).alias("weight_low"),
        F.count_if(F.col("weight_kg") > 10).alias("weight_high"),
    )
    return counts.withColumn("passed", (F.col("bad_materials") + F.col("bad_pairs")) == 0)


def comprehensive_cleanup(df: DataFrame) -> DataFrame:
    """Bad materials, orphans, category names, material names, impossible materials, ranges.

    No rename produces an impossible material, so both material filters run as one.
    """
    kept = clean.drop_erroneous_materials(df, ERRONEOUS_AUDIT + IMPOSSIBLE_MATERIALS)
    kept = clean.standardise_category(clean.fix_orphan_category(kept, name=None))
    kept = clean.rename_materials(kept)
    return clean.range_filter(clean.coerce_numeric(kept, ["weight_kg", "total_distance_km"]))


def comprehensive_steps() -> list[tuple[str, Column]]:
    """Keep-conditions of the row-dropping steps above, for the one-pass audit."""
    text = F.col("materials")
    return [
        ("erroneous materials", ~text_names_any(text, ERRONEOUS_AUDIT)),
        ("impossible materials", ~text_names_any(text, IMPOSSIBLE_MATERIALS)),
        ("missing numbers", F.col("weight_kg").isNotNull() & F.col("total_distance_km").isNotNull()),
        ("weight out of range", F.col("weight_kg").between(*clean.WEIGHT_RANGE)),
        ("distance out of range", F.col("total_distance_km").between(*clean.DISTANCE_RANGE)),
    ]
