"""Operators on hand-made rows: gaps, bad text, repeated keys, ties and empty tables."""

from __future__ import annotations

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from weftline.constants import CATEGORY_RENAMES, CATEGORY_STANDARD, MATERIALS
from weftline.functions.columns import rename_expr, values_table
from weftline.functions.hashing import hash60, hash_uniform
from weftline.functions.ranking import exact_quantiles, expand_counts, hash_rank_thresholds
from weftline.operators import clean, compose, emissions, features, model, profile, split
from weftline.operators.emissions import FactorTable, ModeTable
from weftline.schema import PRODUCT_COLUMNS, PRODUCT_SCHEMA, TARGETS, assert_schema, schema_mismatch
from weftline.sources import products
from weftline.sources.shipments import demo_factors, demo_modes
from weftline.streaming import jobs

TEXTS = {
    "null": None,
    "empty": "",
    "bad": "not json",
    "array": "[1,2]",
    "single": "{'a': 1.0}",
    "doubled": '{""a"":1.0}',
    "twice": '{"a":0.1,"a":0.2}',
    "null_share": '{"a":null}',
    "text_share": '{"a":"0.5"}',
    "short": '{"silk":0.5,"hemp":0.4}',
    "unknown": '{"silk":0.5,"mystery":0.5}',
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, v, 2.0, 100.0) for k, v in TEXTS.items()],
                                 "id string, materials string, weight_kg double, total_distance_km double")


@pytest.fixture(scope="module")
def factors(spark):
    return FactorTable(values_table(spark, [("a", 10.0, 100.0), ("silk", 1.0, 2.0)], ["material", "carbon", "water"]))


@pytest.fixture(scope="module")
def modes(spark):
    return ModeTable(demo_modes(spark))


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_parse_materials(texts):
    got = by_id(compose.with_composition(texts), "composition")
    assert got["null"] is None and got["bad"] is None and got["array"] is None
    assert got["single"] == {"a": 1.0} and got["doubled"] == {"a": 1.0}
    assert got["null_share"] == {"a": None}


def test_pivot_keeps_last_of_repeated_key(texts):
    wide = compose.pivot_materials(compose.with_composition(texts), ["a", "silk"])
    got = {r["id"]: (r["a"], r["silk"]) for r in wide.collect()}
    assert got["twice"] == (0.2, 0.0) and got["unknown"] == (0.0, 0.5) and got["null"] == (0.0, 0.0)


def test_unpivot_reverses_pivot(spark):
    df = spark.createDataFrame([(1, {"silk": 0.4, "hemp": 0.6})], "id int, composition map<string,double>")
    rows = compose.unpivot_materials(compose.pivot_materials(df), ["id"]).collect()
    assert {(r["material"], r["share"]) for r in rows} == {("silk", 0.4), ("hemp", 0.6)}


def test_composition_check(texts):
    got = {r["id"]: r for r in compose.composition_check(compose.with_composition(texts)).collect()}
    assert not got["short"]["sum_ok"] and got["short"]["shares_in_range"]
    assert got["unknown"]["sum_ok"] and got["unknown"]["has_unknown"]
    assert got["unknown"]["unknown_share"] == 0.5


def test_aliases_keep_last(spark):
    df = spark.createDataFrame([({" Cotton": 0.3, "cotton_conventional": 0.6, "LYCRA": 0.1},)], "m map<string,double>")
    assert df.select(compose.normalise_aliases(F.col("m"))).first()[0] == {
        "cotton_conventional": 0.6,
        "elastane": 0.1,
    }


def test_footprint_counts_repeated_keys_and_both_plans_agree(texts, factors, modes):
    small = by_id(emissions.product_footprint(texts, factors, modes), "carbon_material")
    large = FactorTable(factors.table)
    large.rows = None
    joined = by_id(emissions.product_footprint(texts, large, modes), "carbon_material")
    assert small["twice"] == pytest.approx(2.0 * 0.3 * 10) and small["bad"] == 0.0
    assert "null" not in small and "empty" not in small
    assert small == joined
    assert {r["id"] for r in emissions.footprint_rejects(texts).collect()} == {"null", "empty"}


def test_golden_rows(spark, modes):
    """Two published rows; transport within half a percent, because the betas are rounded."""
    table = values_table(spark, [("polyester_virgin", 0.607196 / 0.296, 60.0), ("viscose", 1.5, 3000.0)],
                         ["material", "carbon", "water"])
    df = spark.createDataFrame(
        [("1", 0.296, 14031.53, '{"polyester_virgin": 1.0}'),
         ("2", 0.587, 14321.63, '{"viscose": 0.72, "polyester_virgin": 0.28}')],
        "id string, weight_kg double, total_distance_km double, materials string")
    got = {r["id"]: r for r in emissions.product_footprint(df, FactorTable(table), modes).collect()}
    for key, carbon, transport, water in (("1", 0.607196, 0.070728, 17.76), ("2", 0.971118, 0.142511, 1277.7816)):
        assert got[key]["carbon_material"] == pytest.approx(carbon, abs=1e-6)
        assert got[key]["carbon_transport"] == pytest.approx(transport, rel=5e-3)
        assert got[key]["water_total"] == pytest.approx(water, abs=1e-4)
        assert got[key]["carbon_total"] == got[key]["carbon_material"] + got[key]["carbon_transport"]


def test_modal_split_edges(spark, modes):
    cases = [None, -1.0, 0.0, 0.5, 1.0, 14031.53, 40000.01, 1e30, float("inf")]
    df = spark.createDataFrame([(str(d), d, 1.0) for d in cases], "id string, d double, w double")
    rows = {r["id"]: r for r in emissions.modal_split_check(df, "d", modes).collect()}
    assert [rows[str(d)]["split_valid"] for d in cases] == [False] * 3 + [True] * 5 + [False]
    carbon = by_id(emissions.with_transport_carbon(df, "w", "d", modes), "carbon_transport")
    assert carbon["None"] == carbon["-1.0"] == carbon["inf"] == 0.0 and carbon["0.5"] > 0


def test_bad_modes_are_refused(spark):
    with pytest.raises(ValueError):
        ModeTable(values_table(spark, [("road", 0.0, 0.0, 0.0)], ["mode", "ef", "beta0", "beta1"]))


def test_weight_units_in_sequence(spark):
    df = spark.createDataFrame([(w,) for w in (0.0099, 10.0, 734.0, 0.0, None, 0.01)], "weight_kg double")
    got = [r[0] for r in clean.fix_weight_units(df).collect()]
    assert got == [pytest.approx(9.9), 10.0, pytest.approx(0.734), 0.0, None, 0.01]


def test_recode_order_is_checked():
    for mapping in (CATEGORY_RENAMES, CATEGORY_STANDARD):
        assert not set(mapping) & {v for k, v in mapping.items() if k != v} or mapping is CATEGORY_RENAMES
    with pytest.raises(ValueError):
        rename_expr(None, {"a": "b", "b": "c"})


def test_header_rows(spark):
    df = spark.createDataFrame([("gender", "x"), (None, "x"), ("Male", None), ("Male", "product_name")],
                               "gender string, product_name string")
    assert clean.drop_header_rows(df).count() == 2


def test_drop_materials_reads_escapes(spark):
    df = spark.createDataFrame([('{"pol\\u30ea\\u30a8\\u30b9\\u30c6\\u30eb_virgin": 1.0}',), ('{"silk": 1.0}',), (None,), ("silk",)],
                               "materials string")
    assert clean.drop_erroneous_materials(df).count() == 3


def test_audit_counts_every_row_once(spark):
    df = spark.createDataFrame([(1, None), (None, None), (5, 5), (7, 1)], "a int, b int")
    rows = {r["step"]: r for r in clean.audit(df, [("a", F.col("a") < 6), ("b", F.col("b").isNotNull())]).collect()}
    assert (rows["a"]["removed"], rows["a"]["remaining"]) == (2, 2)
    assert (rows["b"]["removed"], rows["b"]["remaining"]) == (1, 1)


def test_assert_schema(spark):
    empty = spark.createDataFrame([], PRODUCT_SCHEMA)
    assert assert_schema(empty).columns == PRODUCT_COLUMNS
    assert schema_mismatch(empty.drop("gender"), PRODUCT_COLUMNS)["missing"] == ["gender"]
    with pytest.raises(ValueError):
        assert_schema(empty.drop("gender"))


def test_empty_table_keeps_schema(spark, factors, modes):
    empty = spark.createDataFrame([], PRODUCT_SCHEMA).withColumn("id", F.lit("x"))
    done = emissions.product_footprint(empty, factors, modes)
    assert done.count() == 0 and done.columns == [*PRODUCT_COLUMNS, "id", "carbon_material", "water_total",
                                                  "carbon_transport", "carbon_total"]
    assert profile.histogram(empty, "weight_kg", 5).count() == 0
    assert split.exact_split(empty, "id").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles_against_sorting(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([0.0, -3.5, rng.gauss(0, 1e6), rng.random() * 1e-6]) for _ in range(400)] + [7.0] * 300
    rows = [("g" if i % 3 else "h", v) for i, v in enumerate(values)] + [("n", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_quantiles(df, "v", {"lo": 0.25, "mid": 0.5, "hi": 0.999}, ["g"]).collect()}
    assert set(got) == {"g", "h", None}
    for g in ("g", "h"):
        mine = [v for k, v in rows if k == g]
        cuts = statistics.quantiles(mine, n=4, method="inclusive")
        assert got[g]["lo"] == pytest.approx(cuts[0], rel=1e-12) and got[g]["mid"] == pytest.approx(cuts[1], rel=1e-12)
    everything = exact_quantiles(df, "v", {"mid": 0.5}).first()["mid"]
    assert everything == pytest.approx(statistics.median([v for _, v in rows if v is not None]))


def test_quantiles_outside_folds(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(3), float(rng.randrange(50))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, fold int, v double")
    got = {(r["k"], r["held_out"]): r["m"] for r in exact_quantiles(df, "v", {"m": 0.5}, ["k"], leave_out=("fold", 3)).collect()}
    for k, h in itertools.product("ab", range(-1, 3)):
        assert got[(k, h)] == statistics.median([v for kk, f, v in rows if kk == k and f != h])


def test_hash_thresholds_are_exact(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("h", hash60(F.col("id"), "s"))
    cuts = {r["g"]: r for r in hash_rank_thresholds(df.select("g", "h"), "h", {"a": 0.5, "none": 0.0, "all": 1.0}, ["g"]).collect()}
    for g in range(3):
        hashes = sorted(r["h"] for r in df.where(F.col("g") == g).collect())
        assert cuts[g]["a"] == hashes[len(hashes) // 2 - 1] and cuts[g]["none"] == -1 and cuts[g]["all"] == hashes[-1]


@pytest.mark.parametrize("distinct", [1, 2, 90])
def test_exact_split_divides_a_hot_key(spark, distinct):
    """One key holds most rows; the size of the training part is still exact."""
    df = spark.range(90).select(F.lit("hot").alias("key"), (F.col("id") % distinct).alias("x")).unionByName(
        spark.range(10).select(F.col("id").cast("string").alias("key"), F.lit(9).cast("bigint").alias("x")))
    done = split.exact_split(df, "key")
    counts = {r["part"]: r["count"] for r in done.groupBy("part").count().collect()}
    assert counts == {"train": 75, "validation": 25}
    assert sorted(map(tuple, done.drop("part").collect())) == sorted(map(tuple, df.collect()))


def test_expand_counts(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("c", 12)], "k string, n bigint")
    got = {r["k"]: r["count"] for r in expand_counts(df, "n", chunk=4).groupBy("k").count().collect()}
    assert got == {"a": 5, "b": 1, "c": 12}


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"))
    first = split.exact_split(df, "key").collect()
    second = split.exact_split(df.repartition(11), "key").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_corrupt_grid_equals_single_corruptions(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit(1.0).alias("weight_kg"),
                                 F.lit(1.0).alias("total_distance_km"), F.lit(1.0).alias("m"))
    grid = split.corrupt_grid(df, "key", [0.0, 0.3], 2, ["m"])
    for level, trial in itertools.product([0.0, 0.3], range(2)):
        one = split.corrupt(df, "key", level, trial, ["m"])
        cell = grid.where((F.col("level") == level) & (F.col("trial") == trial)).select(*one.columns)
        assert sorted(map(str, one.collect())) == sorted(map(str, cell.collect()))
        lost = one.where("weight_kg IS NULL OR total_distance_km IS NULL OR m = 0").count()
        assert lost == math.floor(200 * level)


def test_mask_rates(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("key"), hash_uniform(F.col("id"), 1).alias("u"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.03


def test_stratum_labels(spark):
    df = spark.createDataFrame([("1", '{"a":1.0}'), ("2", '{"a":0.5,"b":0.5}'), ("3", "bad")], "id string, materials string")
    got = by_id(split.rarest_material_stratum(df, common_at=2, rare_below=1), "stratum")
    assert got == {"1": "Common", "2": "b", "3": "Common"}


def test_material_fallback_ties_and_gaps(spark):
    zero = dict.fromkeys(MATERIALS, 0.0)
    rows = [{"id": "tie", **zero, "hemp": 0.5, "cashmere": 0.5}, {"id": "none", **zero}]
    df = spark.createDataFrame(rows)
    out = features.material_fallback(df, FactorTable(demo_factors(df.sparkSession)))
    got = {r["id"]: r for r in out.collect()}
    assert got["tie"]["dominant_material_idx"] == MATERIALS.index("cashmere")
    assert got["none"]["dominant_material_idx"] == 0 and got["none"]["max_material_carbon_factor"] == 0.0


def test_feature_names():
    names = features.feature_names()
    assert len(names) == len(set(names)) == 93 and len(features.feature_names(formula=False)) == 90


def test_targets_round_trip(spark):
    rows = [(float(i), float(i * i), None if i == 3 else 1.0, 5.0) for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{t} double" for t in TARGETS))
    scaler = model.fit_target_scaler(df)
    for r in model.unscale_targets(model.scale_targets(df, scaler), scaler).collect():
        for t in TARGETS:
            assert r[f"pred_{t}"] == (None if r[t] is None else pytest.approx(r[t], abs=1e-9))


def test_gate_without_level_passes(spark):
    metrics = values_table(spark, [("carbon_total", 0.9, 0.1)], ["target", "r2", "mae"])
    curve = values_table(spark, [(0.2, 0.1)], ["missing_pct", "carbon_total_r2"])
    assert not model.accuracy_gate(metrics, curve, 0.4).first()["retrain"]
    assert model.accuracy_gate(metrics, curve, 0.2).first()["retrain"]


def test_read_products_keeps_rejects(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(
        ",".join(PRODUCT_COLUMNS) + "\n"
        '"a, ""b""","Male","Tops","Polos","IT","{""silk"": 1.0}","0.5","100"\n'
        '"c","Male"\n'
        '"d","Male","Tops","Polos","IT","","x","7"\n'
    )
    rows, rejects = products.read_products(spark, str(path))
    got = {r["product_name"]: r for r in rows.collect()}
    assert got['a, "b"']["materials"] == '{"silk": 1.0}' and got['a, "b"']["weight_kg"] == 0.5
    assert got["d"]["weight_kg"] is None and got["d"]["materials"] is None
    assert [r["line"] for r in rejects.collect()] == ['"c","Male"']


def test_hierarchy_depths(spark):
    nodes = spark.createDataFrame([("1", "Men's", None), ("2", "Tops", "1"), ("3", "Polos", "2"), ("4", "Bags", "1"), ("5", "Misc", None)],
                                  "id string, name string, parent_id string")
    got = {r["category"]: (r["gender"], r["parent_category"], r["full_path"]) for r in products.category_hierarchy(nodes).collect()}
    assert got == {"Polos": ("Men's", "Tops", "Men's > Tops > Polos"), "Bags": ("Men's", "Bags", "Men's > Bags"), "Misc": ("Misc", None, "Misc")}


def test_drift_against_sorting(spark):
    rng = random.Random(3)
    recent, base = [rng.gauss(0, 1) for _ in range(200)] + [0.0] * 50, [rng.gauss(0.4, 1) for _ in range(150)]
    frames = [spark.createDataFrame([("t", v) for v in part], "target string, v double") for part in (recent, base)]
    points = recent + base
    want = max(abs(sum(x <= p for x in recent) / len(recent) - sum(x <= p for x in base) / len(base)) for p in points)
    assert jobs.drift_ks(*frames, "v", "target").first()["ks"] == pytest.approx(want, abs=1e-12)


def test_ingest_restart_appends_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / d) for d in ("in", "out", "ck"))
    line = '"{}","Male","Tops","Polos","IT","{{""silk"": 1.0}}","0.523","1234.5"'
    spark.createDataFrame([(line.format("a"),), ("Here are two, as asked",)], "value string").write.text(source)
    jobs.append_available(jobs.ingest_stream(spark, source), sink, checkpoint).awaitTermination()
    spark.createDataFrame([(line.format("b"),)], "value string").write.mode("append").text(source)
    for _ in range(2):
        jobs.append_available(jobs.ingest_stream(spark, source), sink, checkpoint).awaitTermination()
    assert sorted(r["product_name"] for r in spark.read.parquet(sink).collect()) == ["a", "b"]


@pytest.mark.parametrize("names", [255, 256, 257])
def test_factor_tables_of_any_size_agree(spark, names):
    """A repeated name counts once (the first by order), a NULL name never, at any table size."""
    rows = [(f"m{i}", float(i), 1.0, i) for i in range(names - 1)]
    rows += [("m7", 100.0, 100.0, names), (None, 5.0, 5.0, 0), ("silk", 3.0, 2.0, 1)]
    table = spark.createDataFrame(rows, "material string, carbon double, water double, o int")
    factors = FactorTable(table, order="o")
    df = spark.createDataFrame(
        [("a", 2.0, '{"m7": 0.3, "silk": 0.7}'), ("b", 1.0, None), ("c", None, '{"silk": 1}'), ("d", 1.0, "[]")],
        "id string, weight_kg double, materials string",
    ).withColumn("composition", compose.parse_materials(F.col("materials")))
    got = by_id(emissions.material_footprint(df, factors), "carbon_material")
    assert got == {"a": 2.0 * 0.3 * 7.0 + 2.0 * 0.7 * 3.0, "b": 0.0, "c": None, "d": 0.0}
    assert factors.values("carbon", [f"m{i}" for i in range(names - 1)] + ["none"], -1.0)[-2:] == [float(names - 2), -1.0]


def test_names_are_kept_whatever_the_type_of_the_share(spark):
    df = spark.createDataFrame(
        [("text", '{"polyster_virgin": "50%", "silk": 0.5}'), ("bool", '{"polyester_6": true}'), ("ok", '{"silk": 1}'),
         ("quoted", '{"silk": "0.5"}')],
        "id string, materials string",
    )
    shares = {r["id"]: r["c"] for r in compose.with_composition(df, out="c").collect()}
    assert shares["text"] == {"polyster_virgin": None, "silk": 0.5} and shares["quoted"] == {"silk": 0.5}
    assert {r["id"] for r in clean.drop_erroneous_materials(df).collect()} == {"ok", "quoted"}


def test_renamed_materials_keep_their_digits(spark):
    df = spark.createDataFrame([('{"nylon": 1, "silk": "5%", "a\\"b": 0.25}',), ('{ "silk" : 1 }',)], "materials string")
    got = [r[0] for r in clean.rename_materials(df, {"nylon": "polyamide_6"}).collect()]
    assert got == ['{"polyamide_6": 1, "silk": "5%", "a\\"b": 0.25}', '{ "silk" : 1 }']


def test_a_long_quoted_field_is_parsed(spark):
    from weftline.sources.products import parse_generated_lines

    long = "x" * 100_000
    df = spark.createDataFrame([(f'"{long}","b ""q"" c",1',), (f'"{long},2',)], "value string")
    rows = parse_generated_lines(df, columns=["a", "b", "c"]).collect()
    assert [(len(r["a"]), r["b"], r["c"]) for r in rows] == [(100_000, 'b "q" c', "1")]


@pytest.mark.parametrize("level", [0.0001, 0.2, 0.4])
def test_corruption_is_exact_with_a_hot_key(spark, level):
    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") < 0.4 * n, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id",
        F.lit(1.0).alias("weight_kg"), F.lit(1.0).alias("total_distance_km"), F.lit(1.0).alias("m"),
    )
    grid = split.corrupt_grid(df, "key", [0.0, level], 1, ["m"])
    lost = grid.where("weight_kg IS NULL OR total_distance_km IS NULL OR m = 0").groupBy("level").count().collect()
    assert [tuple(r) for r in lost] == [(level, math.floor(n * level))]
    assert grid.count() == 2 * n


def test_quantiles_pass_over_nan(spark):
    from weftline.functions.ranking import exact_quantiles

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).first()["m"] == 2.0


def test_first_factor_row_is_that_of_the_file_order(spark, tmp_path):
    from weftline.sources.products import read_material_factors

    body = "".join(f"m{i % 500},{i},{i}\n" for i in range(40_000))
    for name, text in (("a.csv", body), ("b.csv", "m0,-1,-1\n")):
        (tmp_path / name).write_text("material,carbon,water\n" + text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {r["material"]: r["carbon"] for r in read_material_factors(spark, str(tmp_path), (0, 1, 2), width=3).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["m0"] == 0.0 and got["m499"] == 499.0 and len(got) == 500


def test_saved_model_scores_alike_in_another_session(spark, tmp_path):
    rows = [(float(i % 7), float(i % 11), float(i % 7) * 2 + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    trained = model.train_multi_target(df, ["a", "b"], ["y"], max_iter=3, min_rows=2, bins=16, columns="all")
    trained.save(spark, str(tmp_path / "m"))
    other = spark.newSession()
    loaded = model.load_model(other, str(tmp_path / "m"))
    again = other.createDataFrame(rows, "a double, b double, y double")
    want, got = (m.predict(d).select("pred_y").collect() for m, d in ((trained, df), (loaded, again)))
    assert sorted(want) == sorted(got) and loaded.names == ["a", "b"]


def test_pca_codes_are_centred_but_not_scaled(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random() * 1000, rng.choice(["Male", "Women's", "Female", "Men's"]), rng.choice(["Tops", "Footwear"])) for _ in range(300)]
    df = spark.createDataFrame([*rows, (1.0, 1.0, "Other", "Tops"), (None, 1.0, "Male", "Tops")],
                               "weight_kg double, total_distance_km double, gender string, parent_category string")
    got = [tuple(r) for r in profile.pca_spread(df).collect()]
    import numpy as np

    x = np.array([[w, d, g in ("Female", "Women's"), p == "Tops", p == "Footwear"] for w, d, g, p in rows], float)
    x[:, :2] = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    variances = np.linalg.svd(x - x.mean(0), compute_uv=False)[:2] ** 2 / len(rows)
    assert len(got) == 300 and np.allclose(np.var(np.array(got), axis=0), variances)


def test_sample_of_a_split_is_stable_and_exact(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    df.repartition(7).write.parquet(str(tmp_path / "s"))
    one, two = (products.read_split(spark, str(tmp_path / "s"), ["id"], n=100).collect() for _ in range(2))
    assert len(one) == 100 and sorted(one) == sorted(two)
    assert products.read_split(spark, str(tmp_path / "s"), ["id"], n=5000).count() == 1000


def test_numbering_up_is_bounded(spark):
    from weftline.functions.ranking import number_up

    df = spark.createDataFrame([("a", 250), ("b", 0), ("c", -1), ("d", None), ("e", 1)], "k string, n long")
    got = number_up(df, F.col("n"), "i", chunk=100).collect()
    assert sorted(r["i"] for r in got if r["k"] == "a") == list(range(250)) and {r["k"] for r in got} == {"a", "e"}
