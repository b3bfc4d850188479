"""Exact ranked lexical search by pair-bound MaxScore.

Documents become segments of impact lists (term -> documents and integer impacts). Besides each
term's largest impact a segment stores, for pairs of terms that stand together in an item, the
intersection of their lists with its largest joint impact. A pair that rarely meets is worth
its larger half, not the sum, so an item's bound falls and more lists and segments are skipped
than by independent maxima. Nothing is approximate: only what can't reach the best is skipped.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.words import SPACE_OR_SIGN, span_hashes, text_blocks, word_spans
from weftline.session import persist_state

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM = T.StructField("item", T.IntegerType())
SLICE = 1024  # documents taken up by a segment at a time


@dataclass(frozen=True)
class Ranking:
    """Settings of the search.

    top:       documents per item
    item_terms: term occurrences of the items searched in one pass; more items take more passes,
               so that what every task holds is bounded
    postings:  of a segment; bounds a task's memory
    seed_one_in: this share of the documents is searched first, to start every task with a
               threshold that is known to be reached (results don't depend on it)
    """

    top: int = 20
    item_terms: int = 1 << 17
    postings: int = 1 << 19
    seed_one_in: int = 64


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Lexicon:
    """The terms of a block of items: numbered in the order of their hashes."""

    def __init__(self, items: list[list[str]]):
        terms = sorted({t for terms in items for t in terms})
        data = [t.encode() for t in terms]
        ends = np.cumsum([len(t) for t in data])
        hashes = span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(t) for t in data], ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {terms[at]: i for i, at in enumerate(order)}
        #: per item its distinct terms and how often each occurs
        self.items = [Counter(number[t] for t in terms) for terms in items]

    def __len__(self) -> int:
        return len(self.hashes)


def count_terms(texts: pa.Array, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of whole texts: first row, rows, all terms per row, and (row * V + term, tf) of the lexicon's."""
    size = len(hashes)
    for first, end, data, offsets in text_blocks(texts):
        starts, ends, counts = word_spans(data, offsets, SPACE_OR_SIGN)
        found = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(hashes, found), size - 1)
        known = np.flatnonzero(hashes[at] == found)
        rows = np.repeat(np.arange(end - first), counts)[known]
        keys, tf = np.unique(rows * size + at[known], return_counts=True)
        yield first, end - first, counts, keys, tf


def forward_index(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tfs`` of every document that has a term at all: one pass, no shuffle."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashes, size = lexicon.hashes, len(lexicon)
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([own.schema["id"]]).add("n", "long").add("terms", numbers).add("tfs", numbers)

    def index(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, rows, counts, keys, tf in count_terms(batch.column(1), hashes):
                offsets = np.searchsorted(keys, np.arange(rows + 1) * size).astype(np.int32)
                terms = pa.ListArray.from_arrays(offsets, pa.array((keys % size).astype(np.int32)))
                tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
                some = pa.array(counts > 0)
                columns = [ids.slice(first, rows), pa.array(counts.astype(np.int64)), terms, tfs]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tfs"]).filter(some)

    return own.mapInArrow(index, schema)


class Segment:
    """Impact lists of some documents, largest impacts of terms, intersections of pairs."""

    def __init__(self, n, offsets, terms, tfs, weights, mean, pairs):
        """``mean`` = (N, L); ``pairs``: the pairs of terms to intersect."""
        documents, total = mean
        self.size = len(n)
        length = 75 + 25 * n * documents // total
        docs = np.repeat(np.arange(self.size), np.diff(offsets))
        tf = tfs.astype(np.int64)
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * length[docs]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.impact = docs[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impact, self.starts[full])
        #: documents that hold both terms, their joint impacts, the largest of these
        self.joint = {pair: self._intersect(*pair) for pair in pairs}

    def list_of(self, term: int):
        own = slice(self.starts[term], self.starts[term + 1])
        return self.docs[own], self.impact[own]

    def _intersect(self, a: int, b: int) -> int:
        (few, x), (many, y) = sorted((self.list_of(a), self.list_of(b)), key=lambda z: len(z[0]))
        if not len(few):
            return 0
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        both = many[at] == few
        return int((x[both] + y[at[both]]).max(initial=0))

    def pair_bound(self, a: int, qa: int, b: int, qb: int) -> int:
        """The most that two terms can add to one document, from their joint maximum."""
        both = self.joint[a, b]
        more = (qa - qb) * int(self.most[a]) if qa > qb else (qb - qa) * int(self.most[b])
        met = min(qa, qb) * both + more if both else 0
        return max(met, qa * int(self.most[a]), qb * int(self.most[b]))

    def bounds(self, chain: list[tuple[int, int]]) -> list[int]:
        """The most that the terms from each place of the chain to its end can add to one document.

        ``chain`` holds an item's (term, times) by falling weight; neighbours are pairs whose
        joint maximum is stored. From the end backwards a term counts alone or together with
        its right neighbour, whichever gives less; without pairs this is the sum of maxima.
        """
        most = [0]
        for i in reversed(range(len(chain))):
            t, q = chain[i]
            alone = most[-1] + q * int(self.most[t])
            if i + 1 < len(chain) and (t, chain[i + 1][0]) in self.joint:
                alone = min(alone, most[-2] + self.pair_bound(t, q, *chain[i + 1]))
            most.append(alone)
        return most[::-1]

    def search(self, chain: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of all documents with a positive score of ``least`` or more.

        Terms from the first place on whose bound is below ``least`` can't carry a document
        alone: only documents of the terms before are scored. They are looked up in the rest,
        list by list, as long as the bound of what is left could still lift them to ``least``.
        """
        chain = [(t, q) for t, q in chain if self.most[t]]
        most, none = self.bounds(chain), np.zeros(0, np.int64)
        if not chain or most[0] < least:
            return none, none, 0
        split = next((i for i, bound in enumerate(most) if bound < least), len(chain))
        score, read = np.zeros(self.size, np.int64), 0
        for t, q in chain[:split]:
            docs, impact = self.list_of(t)
            score[docs] += q * impact
            read += len(docs)
        found = np.flatnonzero(score)
        for i in range(split, len(chain)):
            found = found[score[found] + most[i] >= least]
            if not len(found):
                break
            t, q = chain[i]
            docs, impact = self.list_of(t)
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            held = docs[at] == found
            score[found[held]] += q * impact[at[held]]
            read += len(found)
        found = found[(score[found] >= least) & (score[found] > 0)]
        return found, score[found], read


def chains(lexicon: Lexicon, weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per item its (term, times) by falling weight: rare terms, which seldom meet, are neighbours."""
    return [sorted(terms.items(), key=lambda x: (-int(weights[x[0]]) * x[1], x[0])) for terms in lexicon.items]


def search_index(
    index: DataFrame,
    lexicon: Lexicon,
    weights: np.ndarray,
    mean: tuple[int, int],
    least: list[int],
    settings: Ranking,
) -> DataFrame:
    """``item, id, score``: per task and item the best documents of at least the score ``least``."""
    asked = chains(lexicon, weights)
    pairs = sorted({(a, b) for chain in asked for (a, _), (b, _) in zip(chain, chain[1:])})
    schema = T.StructType([_ITEM, index.schema["id"]]).add("score", "long")

    def segments(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                held.append(part)
                size += len(part.column(2).flatten())
                if size >= settings.postings:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def search(batches):
        best: list[list] = [[] for _ in asked]
        floor, kind = list(least), None
        for part in segments(batches):
            ids, n, terms, tfs = (pa.concat_arrays(part.column(c).chunks) for c in range(4))
            lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs)]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            segment = Segment(n.to_numpy(zero_copy_only=False), offsets, *flat, weights, mean, pairs)
            kind, place = ids.type, np.empty(len(ids), np.int64)
            place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            for i, chain in enumerate(asked):
                docs, scores, _ = segment.search(chain, floor[i])
                if not len(docs):
                    continue
                first = np.lexsort((place[docs], -scores))[: settings.top]
                names = ids.take(pa.array(docs[first])).to_pylist()
                new = [(int(s), (x is not None, x)) for s, x in zip(scores[first], names)]
                best[i] = sorted(best[i] + new, key=lambda x: (-x[0], x[1]))[: settings.top]
                if len(best[i]) == settings.top:
                    floor[i] = max(floor[i], best[i][-1][0])
        rows = [(i, x[1], s) for i, found in enumerate(best) for s, x in found]
        if rows:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), kind, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return index.select("id", "n", "terms", "tfs").mapInArrow(search, schema)


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    settings: Ranking = Ranking(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per item its ``settings.top`` best documents: ``<item_col>, rank, <id_col>, score``.

    Every row of ``items`` is an item, also where ids repeat or are NULL; an item without terms
    has no rows. Every row of ``docs`` is a document, also where ids repeat; equal scores are
    ranked by id, NULL first. Texts without terms (NULL, empty, signs only) are no documents and
    don't count in the statistics. Texts are read whole, once per pass, and only the counts of
    the items' terms are written; other columns, whatever their names, are not read. Empty
    tables give no rows.

    Terms are looked up by 64-bit hashes. Every task returns at most ``top`` documents an item;
    copies with equal scores are cut by id, which is exact, as later ones can't be in the result.
    """
    spark = docs.sparkSession
    low = F.translate(F.coalesce(F.col(item_text), F.lit("")), UPPER, LOWER)
    asked = persist_state(
        items.select(F.col(item_col).alias("_asked"), F.regexp_extract_all(low, F.lit(TERM), 0).alias("_terms"))
        .where(F.size("_terms") > 0)
        .withColumn("_row", F.monotonically_increasing_id()),
        "items",
    )
    occurrences = asked.agg(F.sum(F.size("_terms"))).first()[0] or 0
    blocks = -(-occurrences // settings.item_terms)
    out = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == block).orderBy("_row").collect()
        if not rows:
            continue
        lexicon = Lexicon([r["_terms"] for r in rows])
        index = persist_state(forward_index(docs, lexicon, id_col, text_col), "index")
        documents, total = index.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        counts = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        frequency = dict(map(tuple, counts))
        weights = np.array([weight(documents, frequency.get(t, 0)) for t in range(len(lexicon))], np.int64)
        run = (lexicon, weights, (documents, total))
        some = index.where(F.pmod(F.xxhash64("id", "n"), F.lit(settings.seed_one_in)) == 0)
        least = [0] * len(rows)
        last = ranked(search_index(some, *run, least, settings), settings.top).where(F.col("rank") == settings.top)
        for r in last.collect():
            least[r["item"]] = r["score"]
        names = spark.createDataFrame(
            [(i, r["_asked"]) for i, r in enumerate(rows)], T.StructType([_ITEM, asked.schema["_asked"]])
        )
        best = ranked(search_index(index, *run, least, settings), settings.top).join(names, "item")
        out.append(persist_state(best.select("_asked", "rank", "id", "score"), "ranked"))
    if not out:
        kind = T.StructType([asked.schema["_asked"]]).add("rank", T.IntegerType()).add(docs.schema[id_col]).add("score", "long")
        out.append(spark.createDataFrame([], kind))
    return functools.reduce(DataFrame.unionByName, out).toDF(item_col, "rank", id_col, "score")
