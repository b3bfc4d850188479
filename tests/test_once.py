"""Costly expressions are worked out once per row, wherever the optimiser moves filters."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from weftline.checks import REGISTRY
from weftline.functions.columns import once
from weftline.operators import compose
from weftline.sources.products import parse_generated_lines
from weftline.sources.shipments import shipments


def optimised(df) -> list[str]:
    """Lines of the optimised plan, whole."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.maxPlanStringLength", None)
    conf.set("spark.sql.maxPlanStringLength", "4000000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        conf.unset("spark.sql.maxPlanStringLength") if before is None else conf.set("spark.sql.maxPlanStringLength", before)


def test_once_keeps_values_and_stays_in_place(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, t string").select("id", once(F.upper("t")).alias("u"))
    assert {tuple(r) for r in df.collect()} == {(1, "A"), (2, None), (3, "B")}
    filters = [line for line in optimised(df.where(F.col("u").contains("A") | F.col("u").contains("B"))) if "Filter" in line]
    assert filters and not any("upper" in line for line in filters)


def test_filters_on_materials_do_not_copy_their_expression(spark, sf_dir):
    texts = shipments(spark, sf_dir).where(F.col("materials").contains("nylon") | F.col("materials").contains("silk"))
    assert not any("not json" in line for line in optimised(texts) if "Filter" in line)


@pytest.mark.parametrize(
    ("name", "parses"), [("v12_rename_materials", 6), ("v24_comprehensive_cleanup", 8), ("s4_read_split", 0)]
)
def test_texts_are_parsed_once_per_step(spark, sf_dir, name, parses):
    lines = optimised(REGISTRY[name][0](spark, sf_dir))
    assert sum(len(re.findall(r"from_json\(", line)) for line in lines) <= parses


def test_explode_has_no_second_parse(spark):
    rows = [("a", '{"silk": 0.4, "tpu": null}'), ("b", None), ("c", "{}"), ("d", "not json"), ("e", '{"silk": 1}')]
    df = spark.createDataFrame(rows, "id string, materials string").repartition(2)
    out = compose.explode_materials(compose.with_composition(df), ["id"])
    assert {tuple(r) for r in out.collect()} == {("a", "silk", 0.4), ("a", "tpu", None), ("e", "silk", 1.0)}
    assert sum(line.count("from_json(") for line in optimised(out)) == 2  # both spellings


def test_generated_lines_count_the_commas_outside_quotes(spark):
    lines = [
        '  "a, b","c",d', "a,b,c", 'a,"b ""x, y""",c', r'"a \", b",c,d', 'a,"b,c', 'x"y,z,w', '"a"b,c,"d,e"',
        "a,b", "a,b,c,d", "", "here, it, is", '"",,""', 'a","b,c,d"',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    out = parse_generated_lines(df, columns=["a", "b", "c"])
    text = "\n".join(optimised(out))
    bare = F.regexp_replace(F.trim("value"), r'"(?:[^"\\]++|\\.|"")*+"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    kept = df.where(commas == 2).where(~F.lower(F.trim("value")).startswith("here"))
    assert out.count() == kept.count() > 5
    assert text.count("regexp_replace(") == 1 and text.count("trim(value") == 1
