"""I-Match fingerprints against a plain version, ring order and its edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm.imatch import NO_TERMS, IMatch, fingerprint_documents, likeness, with_next

SCHEMA = "doc_id long, text string"
SMALL = IMatch(low=1.0, high=6.0, rate_bits=(3, 5), subsets=8, counter_bits=10, enough=2, seed=4)


def rows():
    rng = random.Random(9)
    words = [f"t{i}" for i in range(300)] + ["Été", "ñ", "ABC"]
    out = [(i, " ".join(rng.choice(words[: rng.choice((20, 303))]) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    out += [(300, None), (301, ""), (302, "?!"), (303, " ".join(words * 60)), (304, out[3][1]), (None, out[4][1]), (None, None)]
    return out + [out[5], out[5], (7, "same id, other text")]


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute(docs, settings):
    docs = [(i, t or "") for i, t in docs]
    code = lambda t: zlib.crc32(t.encode())
    slot = lambda t: code(t) % (1 << settings.counter_bits)
    df = Counter(slot(t) for _, text in docs for t in terms(text))
    least, most = max(1, math.ceil(len(docs) * math.exp(-settings.high))), max(1, math.floor(len(docs) * math.exp(-settings.low)))

    def hashes(text):
        kept = sorted((t for t in terms(text) if least <= df[slot(t)] <= most), key=str.encode)
        out = []
        for f, bits in enumerate(settings.rate_bits):
            place = lambda t: ((code(t) * settings.multiplier(f)) & 0xFFFFFFFF) >> (32 - bits)  # noqa: B023, E731
            for e in range(8):
                for k in range(settings.subsets // 8):
                    own = [t for t in kept if place(t) == k * 8 + e]
                    out.append(md5(" ".join(own))[:6] if own else NO_TERMS)
        return out if kept else [md5(text)]

    ring = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1].encode()))
    out = []
    for at, (i, text) in enumerate(ring):
        after = ring[(at + 1) % len(ring)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        out.append((i, text, edited, hashes(text), hashes(after), hashes(edited)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(list(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("blocks", [1, 7, 400])
def test_fingerprints_equal_a_plain_version(spark, blocks):
    docs = spark.createDataFrame(rows(), SCHEMA).withColumns(
        {c: F.lit("x") for c in ("hashes", "_block", "_guest", "_own", "_dealt", "next_hashes", "term", "slot")}
    )
    assert got(fingerprint_documents(docs.repartition(5), SMALL, blocks=blocks)) == brute(rows(), SMALL)


def test_other_names_empty_table_and_one_row(spark):
    one = spark.createDataFrame([(1, "abc def")], "key long, body string")
    (row,) = fingerprint_documents(one, SMALL, "key", "body").collect()
    assert row["edited_text"] == "abc d" + "ab" and row["hashes"] == row["next_hashes"]
    assert fingerprint_documents(one.where("false"), SMALL, "key", "body").count() == 0


def test_likeness_is_a_share(spark):
    x, y, n = "aaaaaa", "bbbbbb", NO_TERMS
    cases = [
        ([x] * 16, [x] * 16, 1.0),
        ([x] * 16, [y] * 16, 0.0),
        ([x, y] + [n] * 14, [x, x] + [n] * 14, 0.5),
        ([n] * 8 + [x] * 8, [x] + [n] * 7 + [x] * 4 + [y] * 4, 0.5),  # a family of one subset isn't enough
        (["whole"], ["whole"], 1.0),
        (["whole"], ["other"], 0.0),
        (["whole"], [x] * 16, 0.0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    values = {r["i"]: r["v"] for r in df.select("i", likeness(F.col("a"), F.col("b"), SMALL).alias("v")).collect()}
    assert [values[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_edits_are_nearer_than_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = fingerprint_documents(docs).select(
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("e"), likeness(F.col("hashes"), F.col("next_hashes")).alias("n")
    )
    values = out.collect()
    assert sum(r["e"] > r["n"] for r in values) >= 0.95 * len(values)
    assert sum(r["e"] for r in values) > 0.35 * len(values) and sum(r["n"] for r in values) < 0.05 * len(values)


def test_texts_are_shuffled_once_without_python(spark):
    df = fingerprint_documents(spark.createDataFrame(rows(), SCHEMA), SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text and text.count("Exchange hashpartitioning") == 1
    ring = with_next(spark.createDataFrame(rows(), SCHEMA), "doc_id", "text")
    assert ring.columns == ["doc_id", "text", "next_doc_id", "next_text"]
