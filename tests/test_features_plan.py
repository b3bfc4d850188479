"""The feature pipeline: three joins with its state, one scan of the source to fit, ranked labels."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from weftline.checks.registry import factor_table
from weftline.functions.ranking import numbered
from weftline.operators import features
from weftline.operators.features import CATEGORICALS, Preprocessor
from weftline.session import persist_state


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    from weftline.checks.features import stored_split

    return stored_split(spark, sf_dir)


def test_transform_joins_the_state_three_times(spark, source):
    done = Preprocessor(factor_table(spark)).fit(source).transform(source, training=True, keep=["product_id"])
    text = plan(done)
    assert len(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) ", text)) == 3
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_fit_scans_the_source_once(spark, source, monkeypatch):
    """Every table the fit writes comes from the narrow table but that table itself."""
    folder = re.search(r"split-[0-9a-f]{32}", plan(source))[0]
    scans = []

    def spy(df, purpose="state"):
        scans.append((purpose, folder in plan(df)))
        return persist_state(df, purpose)

    monkeypatch.setattr(features, "persist_state", spy)
    Preprocessor(factor_table(spark)).fit(source)
    assert [purpose for purpose, reads in scans if reads] == ["fit"]


def test_numbering_of_a_million_labels(spark):
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 10 < 9, "many").otherwise("few").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    out = numbered(rows, "g", "v", "code", 16)
    assert "Window" not in plan(out).split("Exchange")[0] or "_range" in plan(out)
    facts = out.groupBy("g").agg(
        F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"), F.countDistinct("code").alias("d")
    )
    for r in facts.collect():
        assert r["low"] == 0 and r["high"] == r["n"] - 1 and r["d"] == r["n"]
    a, b = out.alias("a"), out.alias("b")
    follows = a.join(b, F.expr("a.g = b.g AND a.code + 1 = b.code")).where("a.v >= b.v")
    assert follows.count() == 0


def test_labels_of_null_and_unseen_values(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",), ("é",), ("",)], "category string")
    labels = features.fit_labels(df, ["category"])
    got = {r["key_value"]: r["code"] for r in labels.collect()}
    assert got == {"": 0, "Unknown": 1, "a": 2, "b": 3, "é": 4}
    other = spark.createDataFrame([("z",), (None,)], "category string")
    assert {r["category"]: r["category_encoded"] for r in features.label_encode(other, labels, ["category"]).collect()} == {"z": -1, None: 1}
    assert len(CATEGORICALS) == 3
