"""Pivoted shares and the session's method limit: wide rows cost one pass over their entries."""

from __future__ import annotations

import math

from weftline.checks import REGISTRY
from weftline.operators import compose
from weftline.session import METHOD_LIMIT


def test_pivot_meets_every_entry_once(spark):
    names = ["silk", 'a"b.c', "é", "tpu", "gone"]
    rows = [
        (1, {"silk": 0.1 + 0.2, "tpu": None, "other": 1.0}), (2, {}), (3, None), (4, {'a"b.c': math.inf, "é": -5e-324}),
        (5, {"silk": math.nan, "tpu": -math.inf}), (6, {"SILK": 1.0, "tpu": 1e300}),
    ]
    out = compose.pivot_materials(spark.createDataFrame(rows, "id int, composition map<string,double>"), names)
    for r in out.collect():
        shares = dict(rows)[r["id"]] or {}
        want = [0.0 if shares.get(n) is None else shares[n] for n in names]
        assert list(map(repr, r[2:])) == list(map(repr, want)), r
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(" not in text.replace("element_at(map", "")


def test_last_of_repeated_names_wins(spark):
    df = spark.createDataFrame([(1, '{"silk": 0.2, "tpu": 0.5, "silk": 0.3}')], "id int, materials string")
    (r,) = compose.pivot_materials(compose.with_composition(df), ["silk", "tpu"]).collect()
    assert (r["silk"], r["tpu"]) == (0.3, 0.5)


def test_queries_limit_the_methods_unless_the_session_does(spark, sf_dir):
    ((key, value),) = METHOD_LIMIT.items()
    try:
        spark.conf.set(key, "7000")
        REGISTRY["v3_drop_incomplete"][0](spark, sf_dir)
        assert spark.conf.get(key) == "7000"
        spark.conf.unset(key)
        REGISTRY["v3_drop_incomplete"][0](spark, sf_dir)
        assert spark.conf.get(key) == value
    finally:
        spark.conf.unset(key)
