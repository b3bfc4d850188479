"""Bracketing selection: exact quantiles whatever the distribution, with bounded ordered ranges."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import ranking
from weftline.functions.ranking import bracket, exact_quantiles

PROBABILITIES = {"min": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "max": 1.0}


def values():
    rng = random.Random(8)
    out = [("band", 1.0 + rng.random() * 1e-9) for _ in range(4000)]
    out += [("hot", 5.0) for _ in range(3000)] + [("hot", rng.gauss(5, 1e-6)) for _ in range(500)]
    out += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)]
    out += [("zero", x) for x in (0.0, -0.0, 0.0, -1.5, 2.5, 5e-324, -5e-324)]
    out += [("infinite", x) for x in (math.inf, -math.inf, 1.0, math.inf)]
    out += [("two", 1.0), ("two", 2.0), ("one", 3.0), (None, 4.0), (None, 6.0)]
    out += [("gone", None), ("gone", math.nan), ("hot", None), ("hot", math.nan)]
    return [(g, v, i % 5) for i, (g, v) in enumerate(out)]


SCHEMA = "g string, v double, fold int"


def want(numbers):
    if not numbers:
        return None
    numbers = sorted(numbers)
    out = []
    for p in PROBABILITIES.values():
        at = (len(numbers) - 1) * p
        low, high = numbers[math.floor(at)], numbers[math.ceil(at)]
        out.append(low + (at - math.floor(at)) * (high - low))
    return out


def close(got, expected):
    return all(math.isnan(a) and math.isnan(b) or a == b or abs(a - b) <= 1e-12 * abs(b) for a, b in zip(got, expected))


@pytest.mark.parametrize("bound", [3, 200, 100_000])
def test_quantiles_equal_sorting(spark, monkeypatch, bound):
    monkeypatch.setattr(ranking, "SUB_BINS", 16 if bound == 3 else 4096)
    rows = values()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["g"]: [r[n] for n in PROBABILITIES] for r in exact_quantiles(df, "v", PROBABILITIES, ["g"], ordered_rows=bound).collect()}
    groups = {g for g, v, _ in rows if v is not None and not math.isnan(v)}
    assert set(got) == groups
    for g in groups - {"infinite"}:
        assert close(got[g], want([v for x, v, _ in rows if x == g and v is not None and not math.isnan(v)])), g
    assert got["infinite"][0] == -math.inf and got["infinite"][-1] == math.inf
    total = exact_quantiles(df.where("g = 'band'"), "v", PROBABILITIES, ordered_rows=bound).collect()
    assert len(total) == 1 and close([total[0][n] for n in PROBABILITIES], want([v for g, v, _ in rows if g == "band"]))


@pytest.mark.parametrize("bound", [3, 100_000])
def test_held_out_folds_share_one_histogram(spark, bound):
    rows = [r for r in values() if r[0] != "infinite"]
    df = spark.createDataFrame(rows, SCHEMA)
    out = exact_quantiles(df, "v", PROBABILITIES, ["g"], leave_out=("fold", 5), ordered_rows=bound).collect()
    got = {(r["g"], r["held_out"]): [r[n] for n in PROBABILITIES] for r in out}
    for g in {r[0] for r in rows}:
        for held in range(-1, 5):
            own = [v for x, v, f in rows if x == g and f != held and v is not None and not math.isnan(v)]
            assert (g, held) not in got if not own else close(got[g, held], want(own)), (g, held)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_quantiles(df, "v", PROBABILITIES, ["g"]).count() == 0
    assert [list(r) for r in exact_quantiles(df, "v", {"m": 0.5}).collect()] == [[None]]


def test_no_range_exceeds_the_bound_in_a_narrow_band(spark):
    """A million distinct values within a billionth of one coarse bin."""
    df = spark.range(1_000_000).select((F.lit(2.0) + F.col("id") * 1e-12).alias("_value"))
    found = bracket(df, {"median": 0.5, "p9": 0.9}, [], None, 1000).collect()
    assert all(r["_n"] <= 1000 or r["_lo"] == r["_hi"] for r in found) and len(found) <= 4
    row = exact_quantiles(df, "_value", {"median": 0.5, "p9": 0.9}, ordered_rows=1000).first()
    numbers = np.array([r["_value"] for r in df.collect()])
    assert row["median"] == pytest.approx(np.median(numbers), abs=0) and row["p9"] == pytest.approx(np.quantile(numbers, 0.9))


def test_values_are_filtered_before_they_are_shuffled(spark, monkeypatch):
    """Exchanges carry bin counts or values of located ranges, never the whole column."""
    plans = []
    original = ranking.persist_state

    def spy(df, purpose="state"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, purpose)

    monkeypatch.setattr(ranking, "persist_state", spy)
    df = exact_quantiles(spark.createDataFrame(values(), SCHEMA), "v", {"m": 0.5}, ["g"], ordered_rows=100)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        for line in plan.splitlines():
            if "Exchange hashpartitioning(" in line:
                keys = line.split("hashpartitioning(")[1].split(", ENSURE")[0]
                assert "_value" not in keys or "_bin0" in keys
