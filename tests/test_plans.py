"""The plans stay declarative: no pairwise joins, no Python in the hot path, pruned scans."""

from __future__ import annotations

import re

import pytest

from weftline.checks import REGISTRY

QUERIES = {name: fn for name, (fn, _) in REGISTRY.items()}
TRAINS = ("m2_", "m3_", "m7_", "m10_", "m12_", "a33_")
LAZY = sorted(n for n in QUERIES if n[0] in "pvfal" and not n.startswith(TRAINS))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_or_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert operator not in text


def test_footprints_need_no_shuffle_of_their_own(spark, sf_dir):
    """The only exchange is the one that spreads a small input file over the cores."""
    text = plan(QUERIES["f1_material_carbon"](spark, sf_dir))
    assert len(re.findall(r"(?<!Broadcast)Exchange ", text)) == text.count("RoundRobinPartitioning")


def test_counts_over_dimensions_read_two_columns_of_part(spark, sf_dir):
    text = QUERIES["a7_hierarchy_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("p_type" in s and "p_name" not in s for s in scans)


def test_distance_filter_is_pushed(spark, tmp_path):
    from weftline.operators.clean import drop_distance_outliers

    spark.range(10).selectExpr("cast(id as double) AS total_distance_km", "id AS other").write.parquet(str(tmp_path / "t"))
    df = drop_distance_outliers(spark.read.parquet(str(tmp_path / "t"))).select("total_distance_km")
    text = plan(df)
    assert "LessThanOrEqual(total_distance_km,40000.0)" in text and "other" not in text


def test_examples_are_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["a14_material_examples"](spark, sf_dir))
