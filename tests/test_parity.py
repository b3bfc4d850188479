"""Every registered query of the product operators against its SQL, by value.

On the smallest tables one row key is repeated, so queries that group, join or order by it
are compared on the next size, where keys are unique.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from parity import compare, connect
from weftline.checks import REGISTRY

QUERIES = {name: fn for name, (fn, _) in REGISTRY.items()}
SQL = {name: sql for name, (_, sql) in REGISTRY.items() if sql}
UNIQUE_KEYS = "/root/testdata/sf0.01"
TRAINING = {"m2_train_multi_target", "m3_predict_batch", "m7_robustness_curve", "m10_feature_importance", "m12_training_workflow"}
REPEATED_KEY = {
    "p3_pivot_materials", "p5_composition_check", "p7_material_diversity", "f1_material_carbon", "f2_material_water",
    "f7_product_footprint", "f10_formula_features", "f11_footprint_rollup", "a14_material_examples", "s4_read_split",
    "s6_write_products", "l2_exact_split", "l3_rarest_material_stratum", "l4_stratified_split", "l4_split_coverage",
    "l6_mask_features", "l7_corrupt", "v12_rename_materials", "v24_comprehensive_cleanup", "p6_normalise_aliases",
    "x2_footprint_stream", "a9_material_matrix", "l5_trim_outliers",
} | {n for n in QUERIES if n.startswith(("e", "m"))}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL and n not in REPEATED_KEY))
def test_matches_sql(spark, duck, sf_dir, name):
    status, _ = compare(spark, duck, sf_dir, QUERIES[name], SQL[name])
    assert status == "ok"


@pytest.fixture(scope="module")
def larger_duck():
    return connect(UNIQUE_KEYS)


@pytest.mark.parametrize("name", sorted(REPEATED_KEY & set(SQL)))
def test_matches_sql_with_unique_keys(spark, larger_duck, name):
    status, _ = compare(spark, larger_duck, UNIQUE_KEYS, QUERIES[name], SQL[name])
    assert status == "ok"


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["dim"] for r in rows} == {"category", "parent_category", "gender", "manufacturer_country"}


def test_registry_is_complete():
    """The entry offers every product query; all have SQL but the trained and the unsigned ones."""
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert len(QUERIES) >= 117
    assert set(QUERIES) - set(SQL) == TRAINING | {"a33_pca_spread"}
