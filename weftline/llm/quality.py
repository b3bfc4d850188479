"""Quality of documents by voting of their nearest labelled neighbours in a latent space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.hashing import hash60
from weftline.llm.words import SPACE, span_hashes, text_blocks, word_spans

#: hashed byte trigrams of a text
GRAMS = 2048
#: traits of a text as terms: so many bins for each
BINS = 12
TRAITS = ("distinct words", "capitals", "signs", "digits", "long words", "distinct lines", "words")
TERMS = GRAMS + BINS * len(TRAITS)
#: weight of a trait against the trigrams of a text together
TRAIT_WEIGHT = 0.35
#: texts are scored together in blocks of so many bytes and texts: a text has several rows of
#: TERMS numbers, however short it is
SCORED_BYTES, SCORED_TEXTS = 1 << 20, 256


def _ratio_bin(share: np.ndarray) -> np.ndarray:
    return np.clip((np.nan_to_num(share) * BINS).astype(np.int64), 0, BINS - 1)


def term_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, matrix) of blocks of texts: trigram weights of length 1, and traits."""
    for first, end, _, _ in text_blocks(column, SCORED_BYTES):
        for at in range(first, end, SCORED_TEXTS):
            to = min(at + SCORED_TEXTS, end)
            yield at, to, np.concatenate(list(_terms(column.slice(at, to - at))))


def _terms(column: pa.Array) -> Iterator[np.ndarray]:
    capital = np.zeros(256, bool)
    capital[65:91] = True
    digit = np.zeros(256, bool)
    digit[48:58] = True
    sign = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'" for b in range(256)])
    for first, end, data, offsets in text_blocks(column):
        n, size = end - first, np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        out = np.zeros((n, TERMS), np.float32)
        if len(data) > 2:
            b = data.astype(np.uint32)
            code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35))
            code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 11)
            inside = doc[:-2] == doc[2:]
            spot = doc[:-2][inside] * GRAMS + code[inside]
            grams = np.log1p(np.bincount(spot, minlength=n * GRAMS).reshape(n, GRAMS))
            out[:, :GRAMS] = grams / np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        starts, ends, counts = word_spans(data, offsets, SPACE)
        words = span_hashes(data, starts, ends)
        at = np.concatenate([[0], np.cumsum(counts)])
        distinct = np.array([len(np.unique(words[at[i] : at[i + 1]])) for i in range(n)])
        of_doc = np.repeat(np.arange(n), counts)
        long_words = np.bincount(of_doc[(ends - starts) > 12], minlength=n)
        lines, line_distinct = np.ones(n), np.ones(n)
        newline = np.flatnonzero(data == 10)
        if len(newline):
            cuts = np.unique(np.concatenate([offsets, newline + 1]))
            begin, stop = cuts[:-1], cuts[1:]
            of_line = np.searchsorted(offsets, begin, "right") - 1
            names = span_hashes(data, begin, stop)
            lines = np.maximum(np.bincount(of_line, minlength=n)[:n], 1)
            pairs = np.unique(np.stack([of_line.astype(np.uint64), names], 1), axis=0)[:, 0].astype(np.int64)
            line_distinct = np.maximum(np.bincount(pairs, minlength=n)[:n], 1)
        chars = np.maximum(size, 1)
        per = lambda mask: np.bincount(doc[mask[data]], minlength=n) / chars
        many = np.maximum(counts, 1)
        bins = (
            # long texts repeat more: a text of n words counts as fresh with n ** 0.75 of them
            _ratio_bin(np.minimum(distinct / many**0.75 / 1.5, 1)),
            _ratio_bin(np.minimum(per(capital) * 2.5, 1)),
            _ratio_bin(np.minimum(per(sign) * 5, 1)),
            _ratio_bin(np.minimum(per(digit) * 5, 1)),
            _ratio_bin(np.minimum(long_words / many * 2, 1)),
            _ratio_bin(line_distinct / lines),
            np.clip(np.log2(counts + 1).astype(np.int64), 0, BINS - 1),
        )
        for j, spot in enumerate(bins):
            out[np.arange(n), GRAMS + j * BINS + spot] = TRAIT_WEIGHT
        yield out


@dataclass(frozen=True)
class QualityFit:
    """Bounds and settings of the classifier.

    max_labelled: labelled rows used for each label; the sample's texts stay in the tasks,
                  the driver gets a row of TERMS numbers for each
    dims:         of the latent space
    neighbours:   that vote
    sharpness:    a neighbour votes with similarity ** sharpness
    """

    max_labelled: int = 1500
    dims: int = 64
    neighbours: int = 15
    sharpness: float = 8.0
    seed: int = 17


@dataclass
class QualityModel:
    """Latent axes and the labelled vectors: at most 2 * max_labelled rows of ``dims``."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    neighbours: int
    sharpness: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        x = (terms * self.weight) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the votes of the nearest labelled vectors, block by block."""
        out = np.full(len(terms), 0.5)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(terms), 256):
            near = self.latent(terms[at : at + 256]) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(near, top, 1), 1e-3) ** self.sharpness * self.votes[top]
            out[at : at + 256] = (vote * self.labels[top]).sum(1) / vote.sum(1)
        return np.clip(out.astype(float), 0.0, 1.0)


def fit_quality(
    docs: DataFrame, labels: DataFrame, fit: QualityFit = QualityFit(), id_col="doc_id", text_col="text", label_col="quality"
) -> QualityModel:
    """Learns from a bounded sample of the rows of ``labels`` (id and label 0 or 1).

    The sample holds for each label the ``max_labelled`` rows with the smallest seeded hash;
    votes are weighted back to the share of the labels among all labelled rows. Rows without
    id or label are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"), hash60(F.col(id_col), fit.seed).alias("_draw")
    )
    share = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    picked = [
        known.where(F.col("_label") == label).orderBy("_draw", "_id").limit(fit.max_labelled) for label in (0, 1)
    ]
    sample = F.broadcast(picked[0].union(picked[1]).dropDuplicates(["_id"]))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, rows in term_rows(batch.column(1)):
                body = pa.array([r.tobytes() for r in rows.astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), body],
                    ["_draw", "_label", "terms"],
                )

    rows = (
        docs.join(sample, docs[id_col] == F.col("_id"))
        .select("_draw", F.col(text_col).alias("_text"), "_label")
        .mapInArrow(terms, "_draw long, _label int, terms binary")
        .limit(4 * fit.max_labelled)  # ids may repeat
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r["_draw"], r["_label"], bytes(r["terms"])))
    x = np.frombuffer(b"".join(bytes(r["terms"]) for r in rows), np.float16).reshape(-1, TERMS).astype(np.float32)
    y = np.array([r["_label"] for r in rows], np.float64)
    seen = (x > 0).sum(0)
    weight = np.log1p(len(x) / (1.0 + seen)).astype(np.float32) if len(x) else np.ones(TERMS, np.float32)
    weight[GRAMS:] = 1.0 if not len(x) else np.median(weight[:GRAMS]) + 1.0
    axes = latent_axes(x * weight, fit.dims, fit.seed)
    votes = np.ones(len(y))
    for label in (0, 1):
        drawn = (y == label).sum()
        if drawn:
            votes[y == label] = share.get(label, 0) / drawn
    model = QualityModel(weight, axes, np.zeros((0, axes.shape[1]), np.float32), y, votes, fit.neighbours, fit.sharpness)
    model.vectors = model.latent(x)
    return model


def latent_axes(x: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder."""
    dims = max(1, min(dims, *x.shape)) if len(x) else 1
    if not len(x):
        return np.zeros((x.shape[1], 1), np.float32)
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], min(dims + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ v.T)[:, :dims].astype(np.float32)


def score_quality(docs: DataFrame, model: QualityModel, text_col="text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``: one pass without a shuffle.

    The model is broadcast; its size is bounded by the fit. NULL is an empty text; an empty
    text is scored by its traits like any other. Without any labelled row all scores are 0.5.
    Ids may repeat or be NULL; a column named ``score`` is replaced; an empty table gives no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (keep or docs.columns) if c != "score"]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kind = rows.drop("_text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.num_columns - 1
            for first, end, terms in term_rows(batch.column(text)):
                part = batch.slice(first, end - first)
                columns = [part.column(i) for i in range(text)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.score(terms))], [*keep, "score"])

    return rows.mapInArrow(run, kind)
