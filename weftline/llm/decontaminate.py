"""Benchmark items inside documents, found by exact pieces and verified by edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.numbering import free_name
from weftline.llm.words import SPACE_OR_SIGN, gram_hashes, span_hashes, text_blocks, word_spans
from weftline.session import persist_state

PROBE = 4


@dataclass(frozen=True)
class Budget:
    """What counts as an occurrence of an item of n words.

    share: so many word edits for every word are allowed (rounded down)
    piece: fewest words of a piece; short items get fewer edits, so that pieces keep it
    """

    share: float = 0.15
    piece: int = PROBE

    def edits(self, n: int) -> int:
        return max(0, min(int(n * self.share), n // self.piece - 1))


def split_pieces(n: int, edits: int) -> list[tuple[int, int]]:
    """``edits`` + 1 runs of words that cover an item: one of them survives so many edits."""
    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to a run of ``text``, and the (first best) end.

    Myers' bit-parallel recurrence with one integer of len(pattern) bits; free ends in the
    text.
    """
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for at, word in enumerate(text):
        match = masks.get(word, 0)
        carry = (((match & up) + up) ^ up) | match | down
        raised = down | (~(carry | up) & full)
        lowered = up & carry
        if raised & top:
            score += 1
        elif lowered & top:
            score -= 1
        raised, lowered = (raised << 1) & full, (lowered << 1) & full
        up = lowered | (~((match | down) | raised) & full)
        down = raised & (match | down)
        if score < best:
            best, end = score, at + 1
    return best, end


@dataclass
class Items:
    """A bounded block of items, ready to be looked up: probes are the starts of pieces."""

    ids: list[int]
    words: list[np.ndarray]
    edits: list[int]
    probes: dict[int, np.ndarray] = field(default_factory=dict)
    places: dict[int, list[list[tuple[int, int, int]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]], budget: Budget) -> Items:
        ids, words = [], []
        texts = pa.array([t for _, t in rows], pa.string())
        at = 0
        for first, _, data, offsets in text_blocks(texts):
            starts, ends, counts = word_spans(data, offsets, SPACE_OR_SIGN)
            hashes = span_hashes(data, starts, ends)
            at = 0
            for row, count in enumerate(counts, first):
                if count:
                    ids.append(rows[row][0])
                    words.append(hashes[at : at + count])
                at += count
        out = cls(ids, words, [budget.edits(len(w)) for w in words])
        found: dict[int, dict[int, list]] = {}
        for item, own in enumerate(words):
            for begin, end in split_pieces(len(own), out.edits[item]):
                size = min(PROBE, end - begin)
                probe = int(gram_hashes(own[begin : begin + size], size)[0])
                found.setdefault(size, {}).setdefault(probe, []).append((item, begin, end))
        for size, places in found.items():
            keys = np.array(sorted(places), np.uint64)
            out.probes[size], out.places[size] = keys, [places[int(k)] for k in keys]
        return out

    def search(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, distance, words before its end) of the best occurrence of each item in a text."""
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        for size, keys in self.probes.items():
            grams = gram_hashes(words, size)
            if not len(grams):
                continue
            # one look at a bit table rules out nearly all
            spots = np.flatnonzero(self.table(size)[(grams >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, grams[spots]), len(keys) - 1)
            hit = keys[at] == grams[spots]
            for spot, key in zip(spots[hit].tolist(), at[hit].tolist()):
                for item, begin, end in self.places[size][key]:
                    own, edits = self.words[item], self.edits[item]
                    if not np.array_equal(words[spot : spot + end - begin], own[begin:end]):
                        continue
                    low = max(0, spot - begin - edits)
                    if done.get(item) == low:
                        continue  # an earlier piece has led to the same window
                    if item in best and best[item][0] == 0:
                        continue
                    window = words[low : low + len(own) + 2 * edits].tolist()
                    distance, stop = myers(own.tolist(), window)
                    done[item] = low
                    if distance <= edits and distance < best.get(item, (edits + 1, 0))[0]:
                        best[item] = (distance, low + stop)
        for item, (distance, stop) in best.items():
            yield item, distance, stop

    def table(self, size: int) -> np.ndarray:
        tables = self.__dict__.setdefault("_tables", {})
        if size not in tables:
            tables[size] = np.zeros(1 << 20, bool)
            tables[size][(self.probes[size] >> np.uint64(44)).astype(np.int64)] = True
        return tables[size]


def find_items(
    docs: DataFrame,
    items: DataFrame,
    budget: Budget = Budget(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 8 << 20,
    block_items: int = 20_000,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``n_words``, ``end_word`` of items found in documents.

    Words are runs between ASCII white space and signs, lower-cased (A-Z). An item occurs
    where its word sequence is within ``budget.edits`` edits (insert, delete, replace) of a
    run of the document. It is cut into one piece more than that; each piece's first words
    are looked up exactly, whole pieces compared, and the surroundings verified by Myers'
    bit-parallel distance. The best occurrence per document and item is reported.

    Items are a stated query set: they go to the tasks in blocks of at most ``block_bytes`` of
    text (or one item), each with one pass over the documents, so any number of items is
    served. Items without words and NULL texts match nothing; rows with repeated ids are
    reported each; empty tables give no rows.
    """
    sized = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")
    )
    total = sized.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-total["n"] // block_items), -(-2 * (total["b"] or 0) // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = None
    for block in range(blocks):
        own = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        known = Items.of([(r["item"], r["text"]) for r in own.orderBy("item", "text").collect()], budget)
        found = rows.mapInArrow(
            _searcher(docs.sparkSession.sparkContext.broadcast(known)),
            "doc_id long, item_id long, distance int, n_words int, end_word long",
        )
        out = found if out is None else out.union(found)
    return out


def _searcher(shared):
    names = ["doc_id", "item_id", "distance", "n_words", "end_word"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = shared.value
        for batch in batches:
            rows = []
            for first, _, data, offsets in text_blocks(batch.column(1)):
                starts, ends, counts = word_spans(data, offsets, SPACE_OR_SIGN)
                words = span_hashes(data, starts, ends)
                at = 0
                for row, count in enumerate(counts, first):
                    for item, distance, stop in known.search(words[at : at + count]):
                        doc = batch.column(0)[row].as_py()
                        rows.append((doc, known.ids[item], distance, len(known.words[item]), stop))
                    at += count
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    budget: Budget = Budget(),
    id_col: str = "doc_id",
    text_col: str = "text",
    **names,
) -> DataFrame:
    """``docs`` without those that hold an item.

    A document is told by a 64-bit hash of its id and text, so rows without id and rows that
    share an id are judged by their own texts. Columns of any name are kept.
    """
    key, hit = free_name(docs, "document"), free_name(docs, "hit")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = find_items(keyed, items, budget, id_col=key, text_col=text_col, **names)
    hits = persist_state(found.select(F.col("doc_id").alias(hit)).distinct(), "hits")
    return keyed.join(hits, F.col(key) == F.col(hit), "left_anti").select(*docs.columns)
