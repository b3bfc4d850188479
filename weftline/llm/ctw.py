"""Context-tree weighting over bytes: a corpus model as distributed tables.

A byte is eight binary decisions (a path in a tree of 255 nodes); a context is up to DEPTH
preceding bytes. Every (context, node) has counts of zeros and ones and their
Krichevsky-Trofimov (KT) probability. The weighted probability of a context node is half its
own KT probability and half the product of its children (one byte further back); from it
follows the weight of each depth in a prediction. Trained once and frozen, the prediction of
a byte depends on the DEPTH bytes before it, so a text's probability is a sum over its
grams of DEPTH + 1 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import _LOWER, SPACE, span_hashes, text_blocks, word_spans
from weftline.session import persist_state

DEPTH = 5
#: grams with the same so many bytes next to the predicted one are handled together: at most
#: 256 ** (DEPTH - NEAR + 1) of them
NEAR = 3
#: stands before and after a text; it is no byte of UTF-8
END = 255
BLOCK_BYTES = 12 << 20
#: of a block, so much text is read at once: smaller parts repeat more keys and take longer
READ_BYTES = 1 << 20
#: grams handled at once, on average: near contexts are dealt to groups of about so many
GROUP_GRAMS = 8_000
#: of these so many are weighed at once: a context takes some ten rows of 256 numbers
PIECE_GRAMS = 1_000
#: distinct keys that a task combines before it passes them on
FLUSH = 1 << 18


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting the argument by eight."""
    shifted, product = x + 8, np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log KT probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 nodes (heap order) from the counts of the 256 bytes, per row."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for first in (128, 64, 32, 16, 8, 4, 2, 1):
        tree[:, first : 2 * first] = tree[:, 2 * first : 4 * first : 2] + tree[:, 2 * first + 1 : 4 * first : 2]
    return tree[:, 2:512:2], tree[:, 3:512:2]


def weigh(counts: np.ndarray, children: np.ndarray | None):
    """Log weighted probability, share of the own estimate and chance of a one, for each node.

    children: sum of the children's log weighted probabilities; None at the greatest depth.
    """
    zeros, ones = bit_counts(counts)
    own, chance = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if children is None:
        return own, np.ones_like(own), chance
    whole = np.logaddexp(own, children) - math.log(2)
    return whole, np.exp(own - math.log(2) - whole), chance


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words joined by one blank, DEPTH ends before and one after each text."""
    starts, ends, counts = word_spans(data, offsets, SPACE)
    long = ends - starts
    words_before = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.concatenate([[0], np.cumsum(long + 1)])
    body = sizes[words_before[1:]] - sizes[words_before[:-1]]
    body = np.where(counts > 0, body - 1, 0)  # no blank after the last word
    own = body + DEPTH + 1
    begin = np.concatenate([[0], np.cumsum(own)])
    out = np.full(begin[-1], END, np.uint8)
    of = np.repeat(np.arange(len(counts)), counts)
    to = begin[of] + DEPTH + sizes[:-1] - sizes[words_before[:-1]][of]
    inside = np.repeat(to - np.concatenate([[0], np.cumsum(long)[:-1]]) if len(long) else [], long).astype(np.int64)
    place = inside + np.arange(len(inside))
    source = np.repeat(starts - np.concatenate([[0], np.cumsum(long)[:-1]]) if len(long) else [], long).astype(np.int64)
    out[place] = _LOWER[data[source + np.arange(len(source))]]
    gaps = (to + long)[np.flatnonzero(of[:-1] == of[1:])] if len(of) else np.zeros(0, np.int64)
    out[gaps] = 32
    return out, begin


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts (context bytes, nearest highest but one, then the byte) and counts per text."""
    flat, begin = canonical(data, offsets)
    n = len(flat) - DEPTH
    gram = np.zeros(max(n, 0), np.int64)
    for back in range(1, DEPTH + 1):
        gram = (gram << 8) | flat[DEPTH - back : len(flat) - back]
    gram = (gram << 8) | flat[DEPTH:]
    counts = np.diff(begin) - DEPTH
    # the ends before a text are given, not predicted
    valid = np.ones(len(flat), bool)
    for i in range(DEPTH):
        valid[begin[:-1] + i] = False
    return gram[valid[DEPTH:]], counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts (keys, counts) and the sums of their counts."""
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)


def combined(parts: Iterator[tuple[np.ndarray, np.ndarray]], name: str) -> Iterator[pa.RecordBatch]:
    """Rows (``name``, ``n``) of all parts; about FLUSH keys wait to be combined with later ones."""
    wait, held = [], 0
    for part in parts:
        wait.append(part)
        held += len(part[0])
        if held > FLUSH:
            wait = [merged(wait)]
            held = len(wait[0][0])
            if held > FLUSH // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in wait[0]], [name, "n"])
                wait, held = [], 0
    if wait:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(wait)], [name, "n"])


def _counter(keys_of, name: str):
    """Distinct keys (``keys_of`` bytes and offsets of texts) and their counts, combined in the task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (block for batch in batches for block in text_blocks(batch.column(0)))
        counts = (np.unique(keys_of(data, offsets)[0], return_counts=True) for _, _, data, offsets in blocks)
        yield from combined(counts, name)

    return read


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram``, ``n`` over all rows; NULL is an empty text (one end)."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counter(text_grams, "gram"), "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def dense(keys: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Byte counts of contexts (ordered ``keys``) from grams of context * 256 + byte."""
    out = np.zeros((len(keys), 256))
    np.add.at(out, (np.searchsorted(keys, grams >> 8), grams & 255), n)
    return out


def levels(grams: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, contexts, their byte counts, index of the parent) from DEPTH down to NEAR.

    A context of depth d is its d bytes, the nearest first; the parent has one byte less.
    """
    for depth in range(DEPTH, NEAR - 1, -1):
        byte, context = grams & 255, (grams >> 8) >> (8 * (DEPTH - depth))
        keys = np.unique(context)
        parents = np.searchsorted(np.unique(keys >> 8), keys >> 8)
        yield depth, keys, dense(keys, (context << 8) | byte, n), parents


def up(grams: np.ndarray, n: np.ndarray) -> dict[int, tuple]:
    """Per depth: contexts, share of the own estimate, chance of a one, log weighted probability."""
    out, below = {}, None
    for depth, keys, counts, parents in levels(grams, n):
        whole, share, chance = weigh(counts, below)
        out[depth] = (keys, share, chance, whole, counts)
        if depth > NEAR:
            below = np.zeros((parents.max() + 1, 255))
            np.add.at(below, parents, whole)
    return out


def pieces(grams: np.ndarray) -> Iterator[slice]:
    """Slices of about PIECE_GRAMS ordered grams; each ends where a near context ends."""
    context = grams >> (8 * (DEPTH - NEAR + 1))
    ends = np.append(np.flatnonzero(np.diff(context)) + 1, len(grams))
    at = 0
    while at < len(grams):
        end = int(ends[min(np.searchsorted(ends, at + PIECE_GRAMS), len(ends) - 1)])
        yield slice(at, end)
        at = end


@dataclass
class ContextTree:
    """A trained tree: gram counts, and per depth below NEAR the blended top of each context."""

    grams: DataFrame
    tops: list[DataFrame]


def near(gram: Column) -> Column:
    return F.shiftright(gram, 8 * (DEPTH - NEAR + 1))


def train(docs: DataFrame, text_col: str = "text") -> ContextTree:
    """Counts all texts and weighs the tree from its leaves to its root.

    Depths DEPTH to NEAR in groups of near contexts, then depth by depth in groups of one
    parent (at most 256 children each). All tables stay distributed.
    """
    grams = persist_state(gram_counts(docs, text_col), "grams")

    groups = max(1, -(-grams.count() // GROUP_GRAMS))

    def near_nodes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gram")
        grams, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
        out: dict[str, list] = {"context": [], "whole": [], "counts": []}
        for piece in pieces(grams):
            keys, _, _, whole, counts = up(grams[piece], n[piece])[NEAR]
            for name, values in zip(out, (keys, whole, counts)):
                out[name].extend(values)
        return pd.DataFrame(out)

    kind = "context long, whole array<double>, counts array<double>"
    dealt = grams.groupBy(F.pmod(F.xxhash64(near(F.col("gram"))), F.lit(groups)).alias("group"))
    nodes = {NEAR: persist_state(dealt.applyInPandas(near_nodes, kind), "nodes")}

    def parent(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.stack(rows["counts"]).sum(0, keepdims=True)
        whole, share, chance = weigh(counts, np.stack(rows["whole"]).sum(0, keepdims=True))
        return pd.DataFrame(
            {"context": [key[0]], "whole": list(whole), "counts": list(counts), "share": list(share), "chance": list(chance)}
        )

    for depth in range(NEAR - 1, -1, -1):
        groups = nodes[depth + 1].groupBy(F.shiftright("context", 8).alias("parent"))
        nodes[depth] = persist_state(
            groups.applyInPandas(parent, kind + ", share array<double>, chance array<double>"), "nodes"
        )
    tops: list[DataFrame] = []
    for depth in range(NEAR):
        own = nodes[depth].select("context", "share", "chance")
        sure = F.zip_with("share", "chance", lambda s, c: s * c)
        rest = F.transform("share", lambda s: 1 - s)
        top = own.select("context", sure.alias("sure"), rest.alias("rest"))
        if tops:
            above = tops[-1].toDF("parent", "above", "weight")
            joined = top.join(above, F.shiftright("context", 8) == F.col("parent"))
            times = lambda x: F.zip_with("weight", x, lambda w, v: w * v)
            top = joined.select(
                "context",
                F.zip_with("above", times("sure"), lambda a, b: a + b).alias("sure"),
                times("rest").alias("rest"),
            )
        tops.append(persist_state(top, "tops"))
    return ContextTree(grams, tops)


def predict(grams: np.ndarray, n: np.ndarray, sure: np.ndarray, rest: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Log10 probability of each gram; ``n`` are its training counts.

    sure, rest: per near context the chance of a one contributed by the depths below NEAR, and
    the weight left; ``top`` is each gram's row of them.
    """
    known = n > 0
    tree = up(grams[known], n[known]) if known.any() else {}
    node, total = np.ones(len(grams), np.int64), np.zeros(len(grams))
    place = {}
    for depth, (keys, *_) in tree.items():
        context = (grams >> 8) >> (8 * (DEPTH - depth))
        at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
        place[depth] = (at, keys[at] == context)
    for bit in range(7, -1, -1):
        one = (grams >> bit) & 1
        chance = np.full(len(grams), 0.5)
        for depth in range(DEPTH, NEAR - 1, -1):
            if depth not in tree:
                continue
            _, share, ones, *_ = tree[depth]
            at, seen = place[depth]
            s = share[at, node - 1]
            chance = np.where(seen, s * ones[at, node - 1] + (1 - s) * chance, 0.5)
        chance = sure[top, node - 1] + rest[top, node - 1] * chance
        total += np.log10(np.where(one == 1, chance, 1 - chance))
        node = 2 * node + one
    return total


def gram_scores(tree: ContextTree, grams: DataFrame) -> DataFrame:
    """``gram``, ``score``: log10 probability of the last byte of every (distinct) gram."""
    asked = grams.join(tree.grams, "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"))
    asked = persist_state(asked.withColumn("near", near(F.col("gram"))), "asked")
    found = asked.select("near").distinct()
    # the deepest known part of the context; unknown children predict one half
    for depth, top in enumerate(tree.tops):
        own = top.select(F.col("context").alias(f"c{depth}"), F.struct("sure", "rest").alias(f"t{depth}"))
        found = found.join(own, F.shiftright("near", 8 * (NEAR - depth)) == F.col(f"c{depth}"), "left")
    nothing = F.struct(F.array_repeat(F.lit(0.0), 255).alias("sure"), F.array_repeat(F.lit(1.0), 255).alias("rest"))
    deepest = F.coalesce(*[F.col(f"t{d}") for d in range(NEAR - 1, -1, -1)], nothing)
    found = found.select(F.col("near").alias("at"), deepest.alias("top")).select("at", "top.sure", "top.rest")
    groups = max(1, -(-asked.count() // GROUP_GRAMS))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).alias("group")

    def scores(rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"gram": [], "score": []})
        rows, tops = rows.sort_values("gram"), tops.sort_values("at")
        top = np.searchsorted(tops["at"].to_numpy(), rows["near"].to_numpy())
        sure, rest = np.stack(tops["sure"]), np.stack(tops["rest"])
        grams, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
        found = [predict(grams[piece], n[piece], sure, rest, top[piece]) for piece in pieces(grams)]
        return pd.DataFrame({"gram": grams, "score": np.concatenate(found)})

    return asked.groupBy(group("near")).cogroup(found.groupBy(group("at"))).applyInPandas(scores, "gram long, score double")


class Lookup:
    """Values of 64-bit keys: an open-addressing table for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int64)
        self.keys, self.values = np.append(keys, 0), np.append(values, np.nan)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """NaN for keys that are not in the table."""
        at = self.place(keys)
        found = self.slot[at]
        wrong = np.flatnonzero((self.keys[found] != keys) & (found >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slot[at[wrong]]
            wrong = wrong[(self.keys[found[wrong]] != keys[wrong]) & (found[wrong] >= 0)]
        return self.values[found]


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = word_spans(data, offsets, SPACE)
    return span_hashes(data, starts, ends).astype(np.int64), counts


GRAM, WORD = 0, 1


def _needs(table: pa.Table) -> pa.Table:
    """The distinct grams and words of a block of documents."""
    grams, words = [], []
    for _, _, data, offsets in text_blocks(one_array(table["text"]), READ_BYTES):
        grams.append(np.unique(text_grams(data, offsets)[0]))
        words.append(np.unique(text_words(data, offsets)[0]))
    grams, words = np.unique(np.concatenate(grams)), np.unique(np.concatenate(words))
    keys = np.concatenate([grams, words])
    return pa.table(
        {
            "block": pa.array(np.full(len(keys), table["block"][0].as_py()), pa.int32()),
            "kind": pa.array(np.repeat([GRAM, WORD], [len(grams), len(words)]), pa.int32()),
            "key": pa.array(keys, pa.int64()),
        }
    )


def one_array(column: pa.ChunkedArray) -> pa.Array:
    column = column.cast(pa.large_string()).combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of all rows.

    learn: condition on the rows the models are trained on. ``score`` is the log10 probability
    of a text as the tree sees it: its lower-cased words, joined by one blank, and an end
    (``score * log2(10) / bytes`` is the code length per byte). ``base_score`` is that of the
    word counts: sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the words and the end.

    Neither the counts nor the tree ever gather in one place: documents are dealt to blocks of
    about BLOCK_BYTES, each block asks for the grams and words it holds, the answers are joined
    to the requests and meet the block's documents again.

    NULL texts are empty, which is one token, the end. Rows with repeated or NULL ids are
    scored each; without training rows every bit has probability one half; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), learn.alias("learn"))
    train_rows = rows.where("learn")
    tree = train(train_rows, "text")
    words = persist_state(
        train_rows.select("text").mapInArrow(_counter(text_words, "word"), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "words",
    )
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if("learn").alias("texts")).first()
    ends = size["texts"]
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    blocks = max(1, -(-(size["b"] or 0) // BLOCK_BYTES))
    blocked = rows.select("id", "text", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(blocks)).cast("int").alias("block"))
    needs = persist_state(
        blocked.select("block", "text").groupBy("block").applyInArrow(_needs, "block int, kind int, key long"), "needs"
    )
    grams = needs.where(F.col("kind") == GRAM).select(F.col("key").alias("gram"))
    scores = persist_state(gram_scores(tree, grams.distinct()), "scores")
    known = scores.select(F.lit(GRAM).alias("kind"), F.col("gram").alias("key"), F.col("score").alias("value")).union(
        words.select(F.lit(WORD), "word", F.col("n").cast("double"))
    )
    answers = needs.join(known, ["kind", "key"]).select("block", "kind", "key", "value")
    unit = math.log10(n + 0.1 * (v + 1))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        parts = []
        if texts.num_rows:
            kind, key = answers["kind"].to_numpy(), answers["key"].to_numpy()
            value = answers["value"].to_numpy()
            gram, word = (Lookup(key[kind == k], value[kind == k]) for k in (GRAM, WORD))
            for first, end, data, offsets in text_blocks(one_array(texts["text"]), READ_BYTES):
                grams, of_grams = text_grams(data, offsets)
                tokens, of_words = text_words(data, offsets)
                count = np.nan_to_num(word(tokens))
                base = sums(np.log10(count + 0.1) - unit, of_words) + math.log10(ends + 0.1) - unit
                hits = sums((count > 0).astype(float), of_words) + (ends > 0)
                parts.append((of_words + 1, hits, np.full(end - first, n), base, sums(gram(grams), of_grams)))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * 5
        ids = one_column(texts["id"])
        return pa.table([ids, *(pa.array(c).cast(k) for c, k in zip(columns, kinds[1:]))], names=names)

    kind = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, kind)


def one_column(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of values; every text is summed on its own."""
    out = np.zeros(len(counts))
    filled = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    if len(filled):
        out[filled] = np.add.reduceat(values, starts[filled])
    return out
