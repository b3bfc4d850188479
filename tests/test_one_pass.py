"""Operators that answer from one scan, bounded lists or counts: streams, drift, extremes, duplicates, strata."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.checks import REGISTRY
from weftline.checks.registry import factor_table, mode_table
from weftline.functions.ranking import gap_ranges
from weftline.operators import clean, emissions, profile, split
from weftline.operators.emissions import FactorTable
from weftline.streaming import jobs

PRODUCTS = "product_id string, materials string, weight_kg double, total_distance_km double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, column: str) -> int:
    return sum(column in fields for fields in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)))


# --- streams --------------------------------------------------------------------------------


def test_stream_joins_a_hundred_thousand_factors_and_restarts_exactly(spark, tmp_path):
    names = spark.range(100_000).select(
        F.concat(F.lit("m"), F.col("id")).alias("material"), (F.col("id") * 0.5).alias("carbon"), (F.col("id") * 2.0).alias("water")
    )
    factors, modes = FactorTable(names), mode_table(spark)
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(first):
        rows = [(f"p{i}", f'{{"m{i}": 0.5, "m{99_999 - i}": 0.5}}', 2.0, 100.0) for i in range(first, first + 50)]
        spark.createDataFrame(rows, PRODUCTS).write.mode("append").parquet(source)

    def run():
        jobs.footprint_sink(spark, source, spark.createDataFrame([], PRODUCTS).schema, factors, modes, sink, checkpoint).awaitTermination()
        return {r["product_id"]: r["carbon_material"] for r in spark.read.parquet(sink).collect()}

    arrive(0)
    assert len(run()) == 50
    arrive(50)
    done = run()
    assert done == {f"p{i}": 2.0 * 0.5 * (i * 0.5) + 2.0 * 0.5 * ((99_999 - i) * 0.5) for i in range(100)}
    # the last batch was written but not committed: it is run again and replaces its own rows
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert run() == done and spark.read.parquet(sink).count() == 100
    with pytest.raises(ValueError):
        jobs.footprint_stream(spark, source, spark.createDataFrame([], PRODUCTS).schema, factors, modes)


# --- drift ----------------------------------------------------------------------------------


def samples():
    rng = random.Random(4)
    out = []
    for g, shift, n in (("near", 0.02, 4000), ("far", 1.0, 900), ("same", 0.0, 300), (None, 0.3, 200)):
        out += [(g, rng.gauss(0, 1), 1) for _ in range(n)] + [(g, rng.gauss(shift, 1), 0) for _ in range(n // 2)]
    out += [("band", 1 + rng.random() * 1e-9, i % 2) for i in range(3000)] + [("hot", 7.0, i % 2) for i in range(1000)]
    out += [("hot", 8.0, 1), ("one side", 1.0, 1), ("near", math.nan, 1), ("near", None, 0), ("gone", None, 1)]
    return out


def distance(rows, g):
    a, b = ([v for x, v, r in rows if x == g and r == side and v is not None and not math.isnan(v)] for side in (1, 0))
    if not a or not b:
        return None
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


@pytest.mark.parametrize("bound", [20, 100_000])
def test_drift_is_exact_whatever_the_bound(spark, bound):
    rows = samples()
    df = spark.createDataFrame(rows, "g string, v double, r int")
    got = {x["g"]: x["ks"] for x in jobs.drift_ks(df.where("r = 1"), df.where("r = 0"), "v", "g", bound).collect()}
    assert set(got) == {"near", "far", "same", None, "band", "hot", "one side"}
    for g, ks in got.items():
        want = distance(rows, g)
        assert ks == want if want is None else ks == pytest.approx(want, abs=1e-12), g


def test_drift_orders_few_rows(spark):
    rng = random.Random(6)
    rows = [("g", rng.gauss(0, 1), 1) for _ in range(20_000)] + [("g", rng.gauss(0.5, 1), 0) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g string, _value double, _r int")
    _, ranges = gap_ranges(df, "g", 100_000)
    ordered = ranges.agg(F.sum(F.col("_rn") + F.col("_bn"))).first()[0] or 0
    assert ordered < 0.1 * len(rows)


# --- one scan -------------------------------------------------------------------------------


def test_extremes_read_the_table_once(spark, sf_dir):
    df = REGISTRY["a18_extremes"][0](spark, sf_dir)
    assert scans(df, "l_orderkey") == 1 and "WindowGroupLimit" in plan(df)


def test_extremes_of_ties_gaps_and_few_rows(spark):
    rows = [(i, float(i % 3), None if i < 8 else 1.0) for i in range(10)]
    out = profile.extremes(spark.createDataFrame(rows, "id int, v double, w double"), "id", ["v", "w"], 3).collect()
    got = {(c, s): [r["id"] for r in sorted(out, key=lambda r: r["id"]) if (r["column"], r["side"]) == (c, s)] for c in "vw" for s in ("smallest", "largest")}
    assert got == {("v", "smallest"): [0, 3, 6], ("v", "largest"): [2, 5, 8], ("w", "smallest"): [8, 9], ("w", "largest"): [8, 9]}


def test_footprints_and_reasons_come_from_one_scan(spark, sf_dir):
    assert scans(REGISTRY["f7_product_footprint"][0](spark, sf_dir), "l_orderkey") == 1


def test_written_footprints_are_counted(spark, tmp_path):
    rows = [("a", '{"cotton": 1.0}', 1.0, 10.0), ("b", None, 1.0, 10.0), ("c", " ", None, None), ("d", "{", 2.0, -1.0)]
    df = spark.createDataFrame(rows, PRODUCTS)
    path = str(tmp_path / "out")
    counts = emissions.write_footprints(df, factor_table(spark), mode_table(spark), path)
    assert counts == {"accepted": 2, "rejected": 2}
    out = {r["product_id"]: r for r in spark.read.parquet(path).collect()}
    assert {k for k, r in out.items() if r["rejected"] == "true"} == {"b", "c"} and out["b"]["reason"] == emissions.NO_COMPOSITION
    assert out["b"]["carbon_total"] is None and out["c"]["carbon_transport"] is None and out["d"]["carbon_total"] == 0.0
    want = {r["product_id"]: r["carbon_total"] for r in emissions.product_footprint(df, factor_table(spark), mode_table(spark)).collect()}
    assert {k: out[k]["carbon_total"] for k in want} == want


@pytest.mark.parametrize("name", ["a9_material_matrix", "a32_material_heatmap"])
def test_pairs_are_counted_from_one_parse(spark, sf_dir, name):
    assert scans(REGISTRY[name][0](spark, sf_dir), "l_orderkey") == 0  # everything comes from the written counts


# --- duplicates -----------------------------------------------------------------------------


def duplicates(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (1, None, 1.0), (None, 1, 1.0), (2, "b", math.nan), (2, "b", math.nan), (3, "c", None)]
    rows = [(a, None if b is None else str(b), c) for a, b, c in rows] + [(i, "x", 1.0) for i in range(10, 40)] + [(10, "x", 1.0)] * 3
    return spark.createDataFrame(rows, "a int, b string, c double")


@pytest.mark.parametrize("digest", [None, "1", "struct(a % 3, 'x')"])
def test_duplicates_survive_forced_digest_collisions(spark, digest):
    df, digest = duplicates(spark), digest and F.expr(digest)
    want = sorted(map(str, df.dropDuplicates().collect()))
    got = sorted(map(str, clean.deduplicate_exact(df, digest=digest).collect()))
    assert [g.replace("-0.0", "0.0") for g in got] == [w.replace("-0.0", "0.0") for w in want]


def test_only_digests_of_single_rows_are_shuffled(spark, monkeypatch):
    plans = []
    original = clean.persist_state
    monkeypatch.setattr(clean, "persist_state", lambda df, purpose: plans.append(plan(df)) or original(df, purpose))
    out = clean.deduplicate_exact(duplicates(spark))
    (first,) = plans
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", first) == ["_digest"]
    # rows that occur once are read, anti-joined to a broadcast table and passed on
    assert "BroadcastHashJoin" in plan(out) and "LeftAnti" in plan(out)


# --- strata ---------------------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.0, 0.4, 0.97])
def test_strata_have_exact_sizes_with_a_hot_key(spark, share):
    n = 1000
    rows = [("hot" if i < share * n else f"k{i}", "s", i // 2) for i in range(n)] + [(f"t{i}", "t", i) for i in range(37)]
    rows += [("x", None, 1)] * 10
    df = spark.createDataFrame(rows, "id string, stratum string, v int")
    out = split.stratified_split(df, "id").collect()
    counts = {}
    for r in out:
        counts.setdefault(r["stratum"], {}).setdefault(r["part"], 0)
        counts[r["stratum"]][r["part"]] += 1
    assert counts["s"] == {"train": 800, "validation": 100, "test": 100}
    assert counts["t"] == {"train": 29, "validation": 4, "test": 4} and counts[None] == {"train": 8, "validation": 1, "test": 1}
    assert sorted(tuple(r)[:3] for r in out if r["stratum"]) == sorted(r for r in rows if r[1])


def test_strata_parse_the_names_twice_at_most(spark, sf_dir):
    from weftline.sources.shipments import shipments

    out = split.rarest_material_stratum(shipments(spark, sf_dir))
    assert scans(out, "l_orderkey") == 1  # counts and rarest names are read from written tables


# --- training -------------------------------------------------------------------------------


def test_boosting_stops_by_held_out_rows(spark):
    from weftline.operators import model

    rng = random.Random(1)
    rows = [(x := rng.random(), rng.random(), (5.0 if x > 0.5 else 1.0) + rng.gauss(0, 0.3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    kept = model.train_multi_target(df, ["a", "b"], ["y"], max_iter=500, max_depth=2, step=0.3, stop_share=0.3)
    again = model.train_multi_target(df.repartition(3), ["a", "b"], ["y"], max_iter=500, max_depth=2, step=0.3, stop_share=0.3)
    assert 1 <= kept.rounds["y"] < 500 and again.scaler["y"]["min"] == kept.scaler["y"]["min"]
    fixed = model.train_multi_target(df, ["a", "b"], ["y"], max_iter=3, stop_share=0.0)
    assert fixed.rounds == {"y": 3}
