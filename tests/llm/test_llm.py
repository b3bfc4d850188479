"""Training-data operators against brute force, on small tables with every awkward kind of row."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import ctw, decontaminate, fuzzy_lines, kd_shards, mixing, multi_index, near_dup, pii, quality
from weftline.llm import setsketch, token_counts, words
from weftline.llm.components import connected_components
from weftline.llm.numbering import number_within, rank_values

SYLLABLES = "ka lo mi ne ru ta ve xo pi su da ge".split()


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def documents():
    """(doc_id, text, lang, source, n_chars): gaps, copies, near copies, ties, one long text, repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 60)
    near = [base[:i] + ["changed"] + base[i + 1 :] for i in (5, 30, 55)]
    long = prose(rng, 30_000)
    texts = [None, "", "  \n\t ", "one", "One  TWO", " ".join(base), " ".join(base), "\n".join(base)]
    texts += [" ".join(x) for x in near] + [" ".join(long), " ".join(long[:-1])]
    texts += [" ".join(prose(rng, 40)) for _ in range(30)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "a", "b", None, "c")[i % 5], i) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, " ".join(base), "en", "a", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with those the operators add
    return spark.createDataFrame(documents(), SCHEMA).withColumns(
        {c: F.lit("x") for c in ("size", "score", "shard", "slot", "id", "key", "kinds", "n_lines", "target", "block")}
    )


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


# --- helpers --------------------------------------------------------------------------------


def test_words_equal_plain_splitting():
    texts = [t for _, t, *_ in documents()] + ["É ñ x y", "a\x0bb\x0cc\rd"]
    got = []
    for _, _, data, offsets in words.text_blocks(pa.array(texts), limit=200):
        starts, ends, counts = words.word_spans(data, offsets)
        low = [bytes(data[a:b]).lower() for a, b in zip(starts, ends)]
        hashes = words.span_hashes(data, starts, ends)
        for w, h in zip(low, hashes):
            got.append((w, int(h)))
    assert [w for w, _ in got] == [w for t in texts for w in tokens(t)]
    assert len({h for _, h in got}) == len({w for w, _ in got}) == len(set(got))


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").alias("g"), (F.col("id") % 400).alias("v"))
    rows = number_within(df, ["g"], [F.col("v")], "n", buckets=16).collect()
    for g in ("hot", None):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(700 if g else 300))
    ranked = rank_values(spark.createDataFrame([("b",), (None,), ("a",), ("é",), ("",)], "s string"), "s", "n").collect()
    assert [r["s"] for r in sorted(ranked, key=lambda r: r["n"])] == ["", "a", "b", "é", None]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: c for n, c in got.items()} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 quality --------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.fit_quality(docs, labels.where(~held))
    scored = quality.score_quality(docs, model, keep=["doc_id"]).join(labels.where(held), "doc_id").collect()
    right = collections.Counter((r["quality"], r["score"] >= 0.7) for r in scored)
    assert right[1, True] >= 0.98 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.9 * (right[0, True] + right[0, False])
    again = quality.fit_quality(docs.repartition(7), labels.where(~held).repartition(3))
    assert np.array_equal(again.vectors, model.vectors)


def test_quality_edges(docs, none, spark):
    labels = spark.createDataFrame([(8, 1), (9, 0), (20, 1), (None, 1), (21, None), (20, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(none, model).count() == 0
    blank = quality.fit_quality(docs, labels.where("false"))
    assert {r["score"] for r in quality.score_quality(docs, blank).collect()} == {0.5}


# --- 2 pseudonyms -----------------------------------------------------------------------------


def test_feistel_is_a_permutation_and_goes_back():
    for size in (1, 2, 10, 97, 1000):
        f = pii.Feistel(b"k", size, "t")
        image = [f(i) for i in range(size)]
        assert sorted(image) == list(range(size)) and [f.back(x) for x in image] == list(range(size))
    even = pii.Feistel(b"k", 100, "t")
    assert sorted(even(i, lambda x: x % 2 == 0) for i in range(0, 100, 2)) == list(range(0, 100, 2))


def test_pseudonyms_keep_formats_and_links():
    names = pii.Pseudonyms(b"key")
    text = "4111 1111-1111 1111, 4111111111111111 a@b.com (212) 555-0100 2024-02-29 29.02.2024 10.0.0.1 123-45-6789 GB82 WEST 1234 5698 7654 32."
    new, kinds = pii.replace_values(text, names)
    assert kinds == ["card", "card", "email", "phone", "date", "date", "ip", "ssn", "iban"]
    assert [c if not c.isalnum() else "x" for c in new.replace(new.split()[5], "")][:19] == [c if not c.isalnum() else "x" for c in text][:19]
    digits = [s.strip(",") for s in (new[:19], new[21:37])]
    first, second = (x.replace(" ", "").replace("-", "") for x in digits)
    assert first == second != "4111111111111111" and pii.luhn_digit(first[:-1]) == first[-1]
    dates = [w for w in new.split() if w.count("-") == 2 and len(w) == 10] + [w for w in new.split() if w.count(".") == 2]
    assert dates[0].split("-") == dates[1].split(".")[::-1]
    assert pii.replace_values(new, names)[1] == kinds  # valid again
    plain = "4111111111111112 2023-02-29 999.1.1.1 000-12-3456 1.2.3.4.5 no-reply"
    assert pii.replace_values(plain, names) == (plain, [])
    assert pii.replace_values(text, pii.Pseudonyms(b"other"))[0] != new


@pytest.mark.parametrize(
    "value, behind",
    [
        ("4111 1111 1111 1111", (" 123", "-123", " 12/25", "-12-25", " 1 2", " 1234", "-1234", " 7 and")),
        ("4111111111111111", (" 2", "-2", " 12 25", "-123")),
        ("3782 822463 10005", (" 123", "-9", " 12/25")),
        ("BE68 5390 0754 7034", (" 12", " 1234", " EUR", " ABCD 12")),
    ],
)
def test_signs_behind_a_card_or_account_number_do_not_hide_it(value, behind):
    names = pii.Pseudonyms(b"key")
    kind = "iban" if value[0] == "B" else "card"
    for rest in behind:
        assert pii.replace_values(f"pay {value}{rest}", names) == (f"pay {names(kind, value)}{rest}", [kind])
    for front in ("12 ", "7 ", "1234 "):
        assert names(kind, value) in pii.replace_values(front + value, names)[0]


def test_pseudonymise_edges(docs, none, spark):
    extra = spark.createDataFrame([(1, "card 4111111111111111 " * 3), (None, None), (1, "")], "doc_id long, text string")
    rows = pii.pseudonymise(extra, b"k").collect()
    assert [len(r["kinds"]) for r in rows] == [3, 0, 0] and rows[1]["text"] is None
    assert len(set(rows[0]["text"].split()[1::2])) == 1
    same = pii.pseudonymise(docs, b"k")
    assert same.columns.count("kinds") == 1 and sorted(str(r["text"]) for r in same.collect()) == sorted(str(r[1]) for r in documents())
    assert pii.pseudonymise(none, b"k").count() == 0


# --- 3 mixing ---------------------------------------------------------------------------------


def fill_targets(sizes, weights, cap):
    total, clamped = sum(sizes.values()), set()
    while True:
        free = {s: w for s, w in weights.items() if s not in clamped}
        left = total - sum(cap * sizes[s] for s in clamped)
        level = left / sum(free.values()) if free else 0
        over = {s for s, w in free.items() if level * w > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in clamped else level * weights[s] for s in sizes}
        clamped |= over


def test_mix_targets_and_repeats(docs, none):
    mixed = mixing.mix_sources(docs).select("doc_id", "text", "source", "size", "source_size", "target", "repeats").collect()
    assert len(mixed) == docs.count()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in mixed:
        assert r["size"] == len(tokens(r["text"])) and 0 <= r["repeats"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["repeats"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for r in mixed:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        largest = max(x["size"] for x in mixed if x["source"] == r["source"])
        assert abs(taken[r["source"]] - want[r["source"]]) <= largest
    assert mixing.mix_sources(none).count() == 0


def test_mix_reruns_agree_and_large_sources_are_close(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 90).cast("int")), " ").alias("text"),
    )
    one, two = (mixing.mix_sources(x).select("doc_id", "source", "size", "target", "repeats").collect() for x in (df, df.repartition(9)))
    assert sorted(map(str, one)) == sorted(map(str, two))
    for source in {r["source"] for r in one}:
        own = [r for r in one if r["source"] == source]
        assert abs(sum(r["size"] * r["repeats"] for r in own) - own[0]["target"]) <= 10


# --- 4 nearest neighbours ---------------------------------------------------------------------


def nearest(vectors, query, top):
    unit = {i: np.array(v, float) for i, v in vectors.items()}
    q = unit[query]
    score = {i: (v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())) for i, v in unit.items() if i != query}
    return sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:top]


def test_search_recall_and_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    fit = multi_index.IndexFit(least=50, chunk=100)
    got = collections.defaultdict(list)
    for r in multi_index.search(table, F.col("vec_id") % 50 == 0, fit=fit).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    hits = total = 0
    for q in [i for i in vectors if i % 50 == 0]:
        want = nearest(vectors, q, 5)
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        total += 5
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits / total >= 0.9


def test_search_ties_and_unsound_vectors(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(40, 0, -1)] + [(0, [1.0, 2.0], 0), (50, [2.0, 4.0], 0), (100, [-1.0, 0.0], 0)]
    rows += [(150, None, 0), (200, [0.0, 0.0], 0), (250, [1.0, None], 0), (300, [float("nan"), 1.0], 0), (350, [1.0], 0), (None, [1.0, 1.0], 0)]
    rows += [(0, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = multi_index.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    got = collections.defaultdict(list)
    for r in found:
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}
    assert multi_index.search(table.where("false"), F.lit(True)).count() == 0
    two = multi_index.search(table.where("vec_id IN (1, 100)"), F.lit(True)).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in two) == [(1, 100), (100, 1)]


# --- 5 context trees --------------------------------------------------------------------------


def brute_tree(train, depth):
    """Counts per (context, node) by walking every bit; weighted probabilities by recursion."""
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    for text in train:
        stream = [255] * depth + list(text) + [255]
        for i in range(depth, len(stream)):
            for d in range(depth + 1):
                context = tuple(stream[i - 1 - k] for k in range(d))
                if d:
                    children[context[:-1]].add(context)
                node = 1
                for bit in range(7, -1, -1):
                    b = stream[i] >> bit & 1
                    counts[context, node][b] += 1
                    node = 2 * node + b

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    whole = {}

    def weighted(context, node):
        if (context, node) not in counts:
            return 0.0
        if (context, node) not in whole:
            own = kt(*counts[context, node])
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children[context])
                own = np.logaddexp(own, below) - math.log(2)
            whole[context, node] = own
        return whole[context, node]

    def chance(context_path, node, bit, d=0):
        context = tuple(context_path[:d])
        if (context, node) not in counts:
            # a node without counts, or a context without a place, says one half
            if d and context not in children[context[:-1]]:
                return 0.5
        n = counts.get((context, node), [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        share = math.exp(kt(*n) - math.log(2) - weighted(context, node)) if (context, node) in counts else 0.5
        return share * own + (1 - share) * chance(context_path, node, bit, d + 1)

    def score(text):
        stream, total = [255] * depth + list(text) + [255], 0.0
        for i in range(depth, len(stream)):
            path, node = [stream[i - 1 - k] for k in range(depth)], 1
            for bit in range(7, -1, -1):
                b = stream[i] >> bit & 1
                total += math.log10(chance(path, node, b))
                node = 2 * node + b
        return total

    return score


def test_tree_scores_equal_brute_force(spark, none):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 1000][:30]
    docs = spark.createDataFrame(rows, SCHEMA)
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    canon = lambda t: b" ".join(tokens(t))
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    score = brute_tree([canon(r[1]) for r in known], ctw.DEPTH)
    count = collections.Counter(w for r in known for w in tokens(r[1]))
    n, v = sum(count.values()) + len(known), len(count) + 1
    got = {r["id"]: r for r in ctw.score_texts(docs, learn).collect()}
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        own = [count[w] for w in tokens(text)] + [len(known)]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c > 0 for c in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in own))
        assert r["score"] == pytest.approx(score(canon(text)), rel=1e-9)
    assert ctw.score_texts(none, F.lit(True)).count() == 0


def test_untrained_tree_gives_one_half_per_bit(docs):
    for r in ctw.score_texts(docs.where("doc_id < 7 OR doc_id IS NULL"), F.lit(False)).collect():
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0
    text = "ab c"
    one = ctw.score_texts(docs.where("doc_id = 3").withColumn("text", F.lit(text)), F.lit(False)).first()
    assert one["score"] == pytest.approx(-8 * (len(text) + 1) * math.log10(2))


# --- 6 token counts ---------------------------------------------------------------------------


def test_length_table_answers_every_limit(docs, none):
    encoding = token_counts.load_encoding(open(token_counts.TOKENIZER, "rb").read(), __import__("public_tokenizers").PATTERN)
    lengths = [len(encoding.encode_ordinary(r[1] or "")) for r in documents()]
    table = token_counts.length_table(token_counts.length_histogram(docs, token_counts.token_length(docs))).cache()
    for r in table.collect():
        limit = r["length"]
        assert r["docs"] == lengths.count(limit) and r["docs_longer"] == sum(x > limit for x in lengths)
        assert r["tokens_longer"] == sum(x for x in lengths if x > limit)
        assert r["truncated_total"] == sum(min(x, limit) for x in lengths)
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    for limit in (0, 1, 17, 50, 5000, 10**9):
        assert token_counts.truncated_total(table, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.length_quantile(table, 0.5) == sorted(lengths)[(len(lengths) - 1) // 2]
    empty = token_counts.length_table(token_counts.length_histogram(none, token_counts.token_length(none)))
    assert empty.count() == 0 and token_counts.truncated_total(empty, 5) == 0


# --- 7 near duplicates ------------------------------------------------------------------------


def shingles(text, k):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(sets):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs, none):
    for k in (4, 5):
        rows = near_dup.near_duplicates(docs, k).collect()
        assert len(rows) == docs.count()
        sets = {i: shingles(t, k) for i, t, *_ in documents() if i is not None}
        want = components(sets)
        for r in rows:
            if r["doc_id"] is None:
                assert r["kept"] and r["component_id"] is None
                continue
            assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.drop_near_duplicates(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(ids) == sorted(set(want.values()))  # the row without id is a copy, too


def test_near_copies_of_one_text_form_the_same_groups(spark):
    """A crowd around one text: many copies on either side of the threshold."""
    rng = random.Random(11)
    base = prose(rng, 120)
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        copy = list(base)
        for spot in rng.sample(range(120), rng.choice((1, 2, 3, 4, 5, 8))):
            copy[spot] = "".join(rng.choice(SYLLABLES) for _ in range(4))
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == components({i: shingles(t, 4) for i, t in rows})


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]  # 1500 of 2500
    x, y = (setsketch.registers_of(s, 200) for s in (a, b))
    assert np.array_equal(setsketch.merge(x, y), setsketch.registers_of(np.union1d(a, b), 200))
    guess = setsketch.jaccard_estimate(x[None], y[None], np.array([2000]), np.array([2000]))[0]
    assert abs(guess - 0.6) < 0.15
    same = setsketch.jaccard_estimate(x[None], x[None], np.array([2000]), np.array([2000]))[0]
    assert same > 0.97 and not setsketch.registers_of(a[:0], 8).any()


# --- 8 decontamination ------------------------------------------------------------------------


def semi_global(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(7)
    for _ in range(200):
        pattern = [rng.randint(0, 3) for _ in range(rng.randint(1, 70))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 60))]
        assert decontaminate.myers(pattern, text)[0] == semi_global(pattern, text)


def test_items_are_found_within_their_budget(spark, docs, none):
    rng = random.Random(9)
    items = {i: prose(rng, n) for i, n in enumerate((40, 25, 12, 6, 3))}
    budget = decontaminate.Budget()
    texts = []
    for own in items.values():
        for edits in range(0, 10):
            body = list(own)
            for _ in range(edits):
                spot = rng.randrange(len(body))
                rng.choice((lambda: body.insert(spot, "zz"), lambda: body.__setitem__(spot, "yy"), lambda: len(body) > 1 and body.pop(spot)))()
            texts.append(", ".join(prose(rng, 15)) + " " + " ".join(body).upper() + ". " + " ".join(prose(rng, 15)))
    table = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, ""), (None, "x y")], "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        plain = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        for i, own in items.items():
            distance = semi_global(own, plain)
            if distance <= budget.edits(len(own)):
                want.add((d, i, distance))
    for block in (8 << 20, 100):  # one block of items, and many
        found = decontaminate.find_items(table, bench, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == want
    assert decontaminate.find_items(none, bench).count() == 0
    assert decontaminate.find_items(docs, bench.where("false")).count() == 0
    clean = decontaminate.drop_contaminated(table, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts) + 2)) - {d for d, *_ in want}


# --- 9 fuzzy lines ----------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_edit_distance_equals_dynamic_programming():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(2))
        want = plain_distance(a, b)
        for most in (0, 3, 50):
            assert fuzzy_lines.edit_distance(a, b, most) == min(want, most + 1)


def test_line_dedup_equals_brute_force(spark, docs, none):
    rng = random.Random(12)
    lines = [" ".join(prose(rng, 60)) for _ in range(8)]
    edited = [x.replace(x.split()[k], x.split()[k] + "x", 1) for k, x in enumerate(lines)]
    texts = [None, "", "\n\n", lines[0], lines[0].upper() + "  \n\n" + lines[1]]
    for i in range(14):
        texts.append("\n".join(rng.choice(lines + edited) for _ in range(rng.randint(1, 6))))
    rows = list(enumerate(texts))
    table = spark.createDataFrame([*rows, (None, lines[0])], "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    nodes, where = {}, {}
    for d, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            w = tokens(line)
            if w:
                key = b" ".join(w)
                nodes.setdefault(key, (d, n))
                where[d, n] = key
    parent = {k: k for k in nodes}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(nodes)
    for a in keys:
        for b in keys:
            if a < b and fuzzy_lines.similar(a.decode("latin-1"), b.decode("latin-1")):
                parent[top(a)] = top(b)
    assert len({top(k) for k in keys}) < len(keys)
    first = {}
    for spot, key in sorted(where.items()):
        first.setdefault(top(key), spot)
    got = {r["doc_id"]: r for r in fuzzy_lines.dedup_lines(table).collect()}
    for d, text in rows:
        if text is None:
            assert got[d]["text"] is None and got[d]["n_lines"] == 0
            continue
        want = [x for n, x in enumerate(text.split("\n")) if (d, n) not in where or first[top(where[d, n])] == (d, n)]
        assert got[d]["text"] == "\n".join(want) and got[d]["n_lines"] == len(text.split("\n"))
        assert got[d]["n_removed"] == len(text.split("\n")) - len(want)
    assert got[None]["text"] == lines[0] and got[None]["n_removed"] == 0
    assert fuzzy_lines.dedup_lines(none).count() == 0
    assert fuzzy_lines.dedup_lines(docs).count() == docs.count()


def variants(rng, line):
    """The line with one word replaced, and with edits in one run of a twentieth of its bytes."""
    w = line.split()
    k = rng.randrange(len(w))
    run = max(1, len(line) // 20)
    at = rng.randrange(len(line) - run)
    return " ".join(w[:k] + ["zq"] + w[k + 1 :]), line[:at] + "x" * run + line[at + run :]


def test_similar_lines_of_every_length_share_keys_and_groups(spark):
    rng = random.Random(31)
    lines = [" ".join(prose(rng, n)) for n in (8, 10, 15, 20, 30, 50, 100) for _ in range(30)]
    pairs = [(a, b) for a in lines for b in variants(rng, a) if a != b and fuzzy_lines.similar(a, b)]
    assert len(pairs) > 300
    table = spark.createDataFrame(list(enumerate(x for p in pairs for x in p)), "doc_id long, text string")
    groups = {r["doc"]: r["group"] for r in fuzzy_lines.line_groups(table).select("doc", "group").collect()}
    found = sum(groups[2 * i] == groups[2 * i + 1] for i in range(len(pairs)))
    assert found >= 0.97 * len(pairs)
    # no two lines that aren't variants of one line are linked
    assert len(set(groups.values())) >= len(lines)
    texts = [x.encode().decode("latin-1") for p in pairs[:60] for x in p]
    kept = fuzzy_lines.may_be_similar(*[fuzzy_lines.letter_counts(texts)] * 2)
    assert all(kept[i, j] for i, a in enumerate(texts) for j, b in enumerate(texts) if fuzzy_lines.similar(a, b))


# --- 10 sharding ------------------------------------------------------------------------------


def test_shards_are_even_and_keep_equal_texts(spark, none, docs):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        text = "x" * 40 if i % 30 == 0 else " ".join(prose(rng, rng.randint(0, 60)))
        rows.append((i, text if i % 50 else None, rng.choice(("en", "de", None)), rng.choice(("hot", "hot", "s1", None)), i))
    for shards in (1, 5, 8):
        out = kd_shards.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=shards).collect()
        assert len(out) == len(rows)
        size, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
        for r in out:
            assert r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            homes[r["text"]].add(r["shard"])
        assert sorted(size) == list(range(shards)) and max(size.values()) <= 1.03 * min(size.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(h) == 1 for h in homes.values())
    by_bytes = kd_shards.kd_shards(spark.createDataFrame(rows, SCHEMA), target_bytes=100_000)
    sums = [r[0] for r in by_bytes.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == -(-sum(sums) // 100_000)
    assert kd_shards.kd_shards(none, shards=8).count() == 0
    odd = kd_shards.kd_shards(docs, shards=8)
    assert odd.count() == docs.count() and odd.columns.count("shard") == 1
    again = kd_shards.kd_shards(docs.repartition(5), shards=8)
    assert sorted(map(str, odd.collect())) == sorted(map(str, again.collect()))


def test_a_text_with_a_third_of_all_rows_is_divided(spark):
    rows = [(i, "hot text " * 10 if i % 3 == 0 else f"text {i} " * 10, "en", "a", i) for i in range(3000)]
    out = kd_shards.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(out) == 8 and max(r["b"] for r in out) <= 1.05 * min(r["b"] for r in out)


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_keep_their_promises(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out, columns = {"documents": docs}, docs.columns
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        out[name] = docs
        assert name == "shard" or docs.columns == columns
    ids = {n: [r["doc_id"] for r in df.select("doc_id").collect()] for n, df in out.items()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(i in ids["quality"] for i in ids["documents"] if labels.get(i) == 1)
    texts = {r["doc_id"]: r["text"] for r in out["quality"].collect()}
    assert sorted(ids["near_dedup"]) == sorted(set(components({i: shingles(t, 5) for i, t in texts.items()}).values()))
    bench = [tokens(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    joined = lambda w: b" " + b" ".join(w) + b" "
    held = {i for i in ids["near_dedup"] if any(joined(b) in joined(tokens(texts[i])) for b in bench)}
    assert held.isdisjoint(ids["decontaminate"]) and len(ids["decontaminate"]) <= len(ids["near_dedup"]) - len(held)
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and max(collections.Counter(ids["mix"]).values()) <= 3
    assert sorted(ids["shard"]) == sorted(ids["mix"])


# --- registered queries -----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_mix_sources", "op7_near_duplicates"])
def test_registered_queries_match_sql(spark, name):
    from parity import compare, connect

    from weftline.llm.queries import REGISTRY

    fn, sql = REGISTRY[name]
    assert compare(spark, connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", fn, sql)[0] == "ok"


def test_registered_queries_return_every_document(spark):
    from weftline.llm.queries import REGISTRY

    d = "/root/testdata/sf0.001"
    ids = sorted(r[0] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect())
    for name in ("op1_quality", "op2_pseudonyms", "op5_context_tree", "op9_fuzzy_lines", "op10_kd_shards"):
        assert sorted(r["doc_id"] for r in REGISTRY[name][0](spark, d).select("doc_id").collect()) == ids
