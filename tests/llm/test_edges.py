"""Awkward rows that earlier versions failed on or let through."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, near_dup, pii, token_counts

WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def test_token_counts_of_very_long_runs(spark):
    texts = [" " * 1_000_000, " " * 1_000_000 + "a", "\n" * 300_000 + " x", "a" * 1_000_000, "ab " * 200_000, "." * 300_000, "x" + " \t" * 50_000 + "y"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", token_counts.token_length(df).alias("n")).collect()}
    assert set(got) == set(range(len(texts))) and all(n > 0 for n in got.values())
    # a run of blanks before a word is one piece but for the last blank
    assert got[1] == got[0]


def test_cut_texts_count_like_whole_ones():
    import regex
    from public_tokenizers import PATTERN

    with open(token_counts.TOKENIZER, "rb") as file:
        encoding = token_counts.load_encoding(file.read(), PATTERN)
    pieces, rng = regex.compile(PATTERN), random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("ab Z9é'.\n\t \r　s") for _ in range(rng.randint(0, 40)))
        t = t.replace("Z", " " * rng.choice((1, 5000, 5001)))
        assert token_counts.count_tokens(t, encoding, pieces) == len(encoding.encode_ordinary(t))


def test_private_values_of_single_digits_are_replaced():
    names = pii.Pseudonyms(b"key")
    for t in ("ping 1.2.3.4 now", "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 x"):
        new, kinds = pii.replace_values(t, names)
        assert new != t and kinds, t
    # the same value gets the same pseudonym whatever else the text holds
    a, b = (pii.replace_values(t, names)[0].split()[1] for t in ("server 8.8.8.8 up", "server 8.8.8.8 up in 2021"))
    assert a == b != "8.8.8.8"


@pytest.fixture(scope="module")
def rows():
    base, other, third = text(1), text(2), text(3)
    near = base[:10] + ["changed"] + base[11:]
    join = " ".join
    return [
        (1, join(base), "a"), (2, join(near), "b"), (2, join(other), "c"), (None, join(base), "d"), (None, join(third), "e"),
        (None, join(third[:-1]), "f"), (5, join(other), "g"), (7, join(text(7)), "h"), (7, join(text(7)), "h"), (8, None, "i"), (9, "", "j"),
    ]


def test_near_copies_of_repeated_and_missing_ids_go(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept string").withColumn("_copies", F.lit(1))
    out = near_dup.drop_near_duplicates(df.withColumn("_document", F.lit("x")))
    assert out.columns == ["doc_id", "text", "_kept", "_copies", "_document"]
    groups = [set("abd"), set("cg"), set("ef"), set("h"), set("i"), set("j")]
    left = [r["_kept"] for r in out.collect()]
    assert len(left) == len(groups) and all(len(g & set(left)) == 1 for g in groups)


def test_contaminated_rows_without_or_with_repeated_ids_go(spark):
    item = text(20, 30)
    dirty, clean = " ".join(text(21) + item + text(22)), " ".join(text(23))
    rows = [(1, dirty, "x"), (1, clean, "a"), (None, dirty, "x"), (None, clean, "b"), (2, None, "c"), (2, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hit string").withColumn("_document", F.lit(0))
    bench = spark.createDataFrame([(1, " ".join(item)), (None, None)], "item_id long, text string")
    out = decontaminate.drop_contaminated(df, bench)
    assert out.columns == df.columns and sorted(r["_hit"] for r in out.collect()) == ["a", "b", "c", "d"]
