"""Schemas of the product tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.constants import MATERIALS

PRODUCT_COLUMNS = [
    "product_name",
    "gender",
    "parent_category",
    "category",
    "manufacturer_country",
    "materials",
    "weight_kg",
    "total_distance_km",
]
TARGETS = ["carbon_material", "carbon_transport", "carbon_total", "water_total"]
CATEGORICALS = ["gender", "parent_category", "category"]
NUMERICS = ["weight_kg", "total_distance_km"]
SPLIT_COLUMNS = [c for c in PRODUCT_COLUMNS if c != "materials"] + TARGETS + MATERIALS

PRODUCT_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c in NUMERICS else T.StringType()) for c in PRODUCT_COLUMNS]
)
CATEGORY_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)


def schema_mismatch(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Missing, unexpected and misplaced columns; all empty when the header is exact."""
    return {
        "missing": [c for c in expected if c not in df.columns],
        "unexpected": [c for c in df.columns if c not in expected],
        "misplaced": [
            c for i, c in enumerate(expected) if c in df.columns and i < len(df.columns) and df.columns[i] != c
        ],
    }


def assert_schema(df: DataFrame, expected: list[str] = PRODUCT_COLUMNS) -> DataFrame:
    """Pass the frame through if its header is exactly ``expected``; looks at metadata only."""
    if df.columns != list(expected):
        raise ValueError(f"unexpected header: {schema_mismatch(df, list(expected))}")
    return df
