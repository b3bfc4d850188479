"""Ranked search against plain scoring, and the bounds that skip lists."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.ranked import Lexicon, Ranking, Segment, chains, rank_documents

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, top):
    held = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(h[2] for h in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if c[t]
            )
            if s > 0:
                scores.append((-s, (i is not None, i or 0), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def tables():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(120)] + ["Ünï", "É", "x9", "ABC"]
    rare = [min(int(rng.expovariate(0.04)), 123) for _ in range(40_000)]
    at = iter(rare)
    docs = [(i, rng.choice([" ", ". ", "\n"]).join(vocabulary[next(at)] for _ in range(rng.randint(1, 60)))) for i in range(900)]
    docs += [(2000 + i, docs[3][1]) for i in range(50)]  # a group of copies, with ties beyond the top
    docs += [(5000, " ".join(["w3"] * 30_000)), (5001, None), (5002, ""), (5003, "?! ..."), (None, docs[5][1]), docs[7], docs[7]]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(100, docs[3][1]), (101, "W1 w1, w1; abc"), (102, None), (103, "??"), (104, "unheard of"), (None, "w5 w6"), (100, "w7 w8")]
    return docs, items


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ranked_search_equals_plain_scoring(spark):
    docs, items = tables()
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("id", "n", "score", "item", "terms", "rank")})
    asked = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit("x"))
    want = brute(docs, items, 20)
    assert got(rank_documents(frame.repartition(6), asked, Ranking(postings=500, seed_one_in=3))) == want
    # items in several passes, another number of best documents
    small = rank_documents(frame, asked, Ranking(top=3, item_terms=100, postings=2000))
    assert got(small) == brute(docs, items, 3)


def test_string_ids_and_empty_tables(spark):
    docs, items = tables()
    named = spark.createDataFrame(docs, DOCS).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    asked = spark.createDataFrame(items, ITEMS)
    want = sorted([(a, r, i if i is None else f"d{i:05d}", s) for a, r, i, s in brute(docs, items, 20)], key=repr)
    assert got(rank_documents(named, asked)) == want
    assert rank_documents(named.where("false"), asked).count() == 0
    assert rank_documents(named, asked.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def segments(docs, items):
    lexicon = Lexicon([terms(t) for _, t in items if terms(t)])
    known = {int(h): i for i, h in enumerate(lexicon.hashes)}
    from weftline.llm.ranked import count_terms
    import pyarrow as pa

    rows = [t for _, t in docs if terms(t)]
    parts = list(count_terms(pa.array(rows), lexicon.hashes))
    assert len(parts) == 1 and len(known) == len(lexicon)
    _, size, n, keys, tf = parts[0]
    offsets = np.searchsorted(keys, np.arange(size + 1) * len(lexicon))
    df = np.bincount(keys % len(lexicon), minlength=len(lexicon))
    weights = np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * f + 1))) for f in df])
    asked = chains(lexicon, weights)
    pairs = sorted({(a, b) for c in asked for (a, _), (b, _) in zip(c, c[1:])})
    build = lambda p: Segment(n, offsets, (keys % len(lexicon)).astype(np.int32), tf, weights, (size, int(n.sum())), p)
    return build(pairs), build([]), asked


def test_pair_bounds_hold_and_skip_more_than_single_bounds():
    docs, items = tables()
    paired, single, asked = segments(docs, items)
    tighter, read_paired, read_single = 0, 0, 0
    for chain in asked:
        everything, scores, _ = single.search(chain, 0)
        if not len(scores):
            continue
        for segment in (paired, single):
            for i, bound in enumerate(segment.bounds(chain)):
                own = np.zeros(segment.size, np.int64)
                for t, q in chain[i:]:
                    d, impact = segment.list_of(t)
                    own[d] += q * impact
                assert own.max() <= bound
        with_pairs, alone = (s.bounds(chain)[0] for s in (paired, single))
        assert scores.max() <= with_pairs <= alone
        tighter += with_pairs < alone
        least = int(np.sort(scores)[-min(5, len(scores))])
        want = sorted(zip(everything[scores >= least], scores[scores >= least]))
        for segment in (paired, single):
            found, s, read = segment.search(chain, least)
            assert sorted(zip(found, s)) == want
            read_paired, read_single = read_paired + read * (segment is paired), read_single + read * (segment is single)
        assert len(paired.search(chain, with_pairs + 1)[0]) == 0 and paired.search(chain, with_pairs + 1)[2] == 0
    assert tighter >= len(asked) // 2 and read_paired < read_single
