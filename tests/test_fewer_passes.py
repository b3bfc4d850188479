"""Steps that passed over their source, or sorted it, more often than needed."""

from __future__ import annotations

import re

from weftline.checks import REGISTRY
from weftline.checks.registry import factor_table
from weftline.operators import clean, compose, emissions, split
from weftline.session import persist_state


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_repeated_rows_are_compared_at_once(spark, monkeypatch):
    rows = [(i % 50, None if i % 3 else "x", i % 2 / 4) for i in range(200)] + [(i, "y", 1.0) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    monkeypatch.setattr(clean, "MAX_REPEATED", 10)
    out = clean.deduplicate_exact(df)
    assert "Join" not in plan(out)
    assert sorted(map(str, out.collect())) == sorted(map(str, df.dropDuplicates().collect()))


def test_name_sets_are_counted_without_a_sort(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(split, "persist_state", lambda df, purpose: plans.update({purpose: plan(df)}) or persist_state(df, purpose))
    rows = [(1, '{"silk": 0.5, "tpu": 0.5}'), (2, '{"tpu": 1, "silk": 0}'), (3, '{"tpu": 1}'), (4, None), (5, "{}"), (6, "bad")]
    df = spark.createDataFrame(rows, "id int, materials string")
    got = {r["id"]: r["stratum"] for r in split.rarest_material_stratum(df, 3, 1).collect()}
    assert got == {1: "silk", 2: "silk", 3: "Common", 4: "Common", 5: "Common", 6: "Common"}
    assert "Sort" not in plans["name-sets"] and plans["name-sets"].count("from_json(") <= 2


def test_large_factor_tables_read_the_products_twice(spark, tmp_path):
    rows = [(1, '{"silk": 0.5, "tpu": 0.5}', 2.0), (2, None, 1.0), (3, "{}", 1.0), (4, '{"silk": 1}', None), (5, '{"x": 1}', 1.0), (6, None, None)]
    spark.createDataFrame(rows, "id int, materials string, weight_kg double").write.parquet(str(tmp_path / "in"))
    df = compose.with_composition(spark.read.parquet(str(tmp_path / "in")))
    few, many = factor_table(spark), factor_table(spark)
    many.rows = None
    want = {r["id"]: (r["carbon_material"], r["water_total"]) for r in emissions.material_footprint(df, few).collect()}
    out = emissions.material_footprint(df, many)
    assert {r["id"]: (r["carbon_material"], r["water_total"]) for r in out.collect()} == want
    assert len(re.findall(r"FileScan parquet \[[^\]]*materials#", plan(emissions.material_footprint(df, many)))) == 2


def test_gate_reads_written_outputs(spark, sf_dir):
    assert "l_orderkey" not in plan(REGISTRY["m8_accuracy_gate"][0](spark, sf_dir))
