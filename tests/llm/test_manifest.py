"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm.merkle import merkle_manifest, verify_manifest
from weftline.llm.ordered import positions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text=...):
    doc_id, own, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars, own if text is ... else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str], fanout: int):
    """The root and per node its (left, right) siblings up to it."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p - p % fanout : p - p % fanout + fanout]
            paths[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], paths


def brute(rows, fanout, changed):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, *tree([leaf(r) for r in own], fanout)
    root, tops = tree([trees[s][1] for s in sources], fanout)
    out = []
    for s, top in zip(sources, tops):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            path = path + top
            now = leaf(r, changed(r))
            for left, right in path:
                now = sha(left + now + right)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(5)
    sizes = {"hot": 130, "b": 1, "é": 9, "z": 10, "": 3, None: 28, "two": 2}
    out = [
        (i, rng.choice(["a\nb", "x" * 30_000, "", None, "no break", "ñ\n\n"]), rng.choice(["en", None]), s, i % 7 or None)
        for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))
    ]
    rng.shuffle(out)
    return out + [out[0], out[0], out[0], (None, "a\n", "en", "hot", 1), (None, "b", "en", "hot", 1), (None, None, None, None, None)]


def got(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout,storey", [(3, 2), (3, 6), (2, 3)])
def test_manifest_equals_a_plain_tree(spark, fanout, storey):
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "tree", "node", "path", "root", "block")})
    tampered = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = verify_manifest(merkle_manifest(df.repartition(5), tampered, fanout, storey=storey))
    changed = lambda r: r[1].replace("\n", "") if r[0] is not None and r[0] % 2 == 0 and r[1] is not None else r[1]
    want = brute(rows(), fanout, changed)
    assert got(manifest) == want
    assert {w[-1] for w in want} == {True, False}


def test_untampered_manifest_verifies(spark):
    assert all(r[-1] for r in got(verify_manifest(merkle_manifest(spark.createDataFrame(rows(), SCHEMA)))))


def test_empty_table_and_single_row(spark):
    assert verify_manifest(merkle_manifest(spark.createDataFrame([], SCHEMA))).count() == 0
    one = (7, "t", None, "s", 1)
    assert got(verify_manifest(merkle_manifest(spark.createDataFrame([one], SCHEMA)))) == [
        (7, leaf(one), leaf(one), leaf(one), sha(""), leaf(one), True)
    ]


def test_positions_of_hot_repeated_and_null_groups(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2500, "b").alias("g"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("v"),
    )
    out = positions(df, "g", [F.col("v").asc_nulls_first()], 8).collect()
    for g, n in (("hot", 2000), ("b", 500), (None, 500)):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(n)) and {r["members"] for r in mine} == {n}
        values = [-1 if r["v"] is None else r["v"] for r in mine]
        assert values == sorted(values)


def test_only_digests_are_shuffled_and_no_python_runs(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    text = verify_manifest(merkle_manifest(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "MapInArrow" not in text and "text#" not in text
