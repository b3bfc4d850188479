"""The lists of extremes sort only the rows that can be in them."""

from __future__ import annotations

import math

from weftline.operators import profile


def test_few_rows_reach_the_limits(spark):
    df = spark.range(20_000).selectExpr("id", "pmod(id * 7919, 20011) / 7.0 AS v", "if(id % 2 = 0, -1.0, NULL) AS w")
    limits = profile._reached_by(df, "id", ["v", "w"], 5)
    assert 5 <= df.where(f"v <= {limits['v', 'smallest']}").count() < 50
    assert 5 <= df.where(f"-v <= {limits['v', 'largest']}").count() < 50
    assert limits["w", "smallest"] == -1.0 and limits["w", "largest"] == 1.0
    got = profile.extremes(df, "id", ["v", "w"], 5).collect()
    rows = df.collect()
    for c in ("v", "w"):
        for side, sign in (("smallest", 1), ("largest", -1)):
            want = sorted((r[c] * sign, r["id"]) for r in rows if r[c] is not None)[:5]
            assert sorted((x["value"] * sign, x["id"]) for x in got if (x["column"], x["side"]) == (c, side)) == want


def test_nan_few_and_repeated_ids(spark):
    rows = [(1, math.nan), (1, 2.0), (1, 2.0), (None, 0.0), (3, -0.0), (4, None)]
    df = spark.createDataFrame(rows, "id int, v double")
    for k in (2, 3, 10, 2_000):
        got = profile.extremes(df, "id", ["v"], k).collect()
        least = sorted([0.0, -0.0, 2.0, 2.0, math.nan], key=lambda v: (v != v, v))[:k]
        most = [2.0, 2.0, 0.0, 0.0, math.nan][:k]
        for side, want in (("smallest", least), ("largest", most)):
            values = sorted((abs(x["value"]) for x in got if x["side"] == side), key=lambda v: (v != v, v))
            assert list(map(str, values)) == list(map(str, sorted(map(abs, want), key=lambda v: (v != v, v))))
