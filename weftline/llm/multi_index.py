"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.hashing import hash60
from weftline.session import persist_state


@dataclass(frozen=True)
class IndexFit:
    """Bounds and settings of the index.

    sample:     vectors used to fit the centroids (those with the smallest seeded hash)
    centroids:  for each of the two halves; cells are their pairs
    rounds:     of k-means
    recall:     share of the true neighbours that a search of the sample has to find; from it
                follows the share of all vectors a query visits (whole cells, nearest first)
    trials:     queries of the sample that measure this
    least:      vectors a query visits at least
    chunk:      vectors, and queries, that are compared at once; larger cells are divided
    """

    sample: int = 20_000
    centroids: int = 16
    rounds: int = 12
    recall: float = 0.97
    trials: int = 200
    least: int = 2_000
    chunk: int = 2_000
    seed: int = 23


@dataclass
class MultiIndex:
    """Centroids of both halves of unit vectors."""

    split: int
    left: np.ndarray
    right: np.ndarray
    share: float = 1.0

    def cells(self, unit: np.ndarray) -> np.ndarray:
        x, y = unit[:, : self.split], unit[:, self.split :]
        return nearest(x, self.left) * len(self.right) + nearest(y, self.right)

    def route(self, unit: np.ndarray, sizes: np.ndarray, wanted: int) -> Iterator[int]:
        """Cells by the summed distance of their two centroids until ``wanted`` vectors are in.

        The multi-sequence traversal: both centroid lists are sorted, a heap holds the next
        pair of each row; empty cells are passed over.
        """
        a = ((self.left - unit[: self.split]) ** 2).sum(1)
        b = ((self.right - unit[self.split :]) ** 2).sum(1)
        first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, reached, seen = [(a[first[0]] + b[second[0]], 0, 0)], 0, {(0, 0)}
        while heap and reached < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(first[i]) * len(self.right) + int(second[j])
            if sizes[cell]:
                reached += sizes[cell]
                yield cell
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(first) and j2 < len(second) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (a[first[i2]] + b[second[j2]], i2, j2))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of a sample; fewer distinct rows than ``k`` are their own centroids."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centroids)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        empty = count == 0
        total[empty], count[empty] = x[rng.choice(len(x), int(empty.sum()))], 1
        centroids = total / count[:, None]
    return centroids


def as_unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x / (m := np.abs(x).max(1, keepdims=True)), axis=1, keepdims=True) / m


def evened(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two: no cosine changes, no square of a huge or tiny component is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def sound(vector: Column, length: int | Column) -> Column:
    """Neither NULL nor zero, only finite components, and of the common length."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == length) & fine & F.exists(vector, lambda x: x != 0)


def search(
    vectors: DataFrame, queries: Column, top: int = 5, fit: IndexFit = IndexFit(), id_col="vec_id", vector_col="embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` and ``visited`` of each query's nearest rows.

    queries: condition on the rows of ``vectors`` that marks the queries. Candidates are all
    rows but those with the query's own id; nearness is the cosine in double precision, ties
    go to the smaller id.

    Equal vectors are one entry with their ``top`` + 1 smallest ids (enough for any answer,
    and what keeps a vector with a third of all rows out of the search). Entries lie in cells
    of two quantised halves; every query visits cells in the order of the summed centroid
    distance; how far is learnt from the recall of the sample. Crowded cells are divided, by
    entries and by queries, so that a task compares at most ``chunk`` of each (on average).
    Only best lists are shuffled after that.

    Vectors that are NULL, zero, not finite or not as long as most are take no part. Ids that
    are NULL take no part; a repeated id counts once for each different vector. Too few
    candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double, visited long"
    if lengths is None:
        return spark.createDataFrame([], result)
    # -0.0 and 0.0 are one
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    rows = persist_state(
        rows.where(sound(F.col("v"), lengths["n"]))
        .withColumn("v", plain)
        .withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)),
        "vectors",
    )
    few = Window.partitionBy("key").orderBy("id")
    entries = (
        rows.select("key", "id").distinct().withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= top + 1)
        .groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    bodies = rows.groupBy("key").agg(F.first("v").alias("v"))
    entries = entries.join(bodies, "key")
    sample = rows.select(hash60(F.col("key"), fit.seed).alias("d"), "v").distinct().orderBy("d").limit(fit.sample)
    index = fit_index([r["v"] for r in sample.collect()], fit)
    if index is None:
        return spark.createDataFrame([], result)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(as_unit(v)) if len(v) else [], dtype="int32")

    entries = persist_state(entries.withColumn("cell", cell_of("v")), "entries")
    sizes = {r["cell"]: r["count"] for r in entries.groupBy("cell").count().collect()}
    count = np.zeros(len(index.left) * len(index.right), np.int64)
    for cell, n in sizes.items():
        count[cell] = n
    wanted = max(fit.least, int(np.ceil(index.share * count.sum())))
    known = spark.sparkContext.broadcast(count)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [list(shared.value.route(u, known.value, wanted)) for u in as_unit(batch["v"])] if len(batch) else []
            visited = [int(known.value[own].sum()) for own in cells]
            yield pd.DataFrame({"key": batch["key"], "v": batch["v"], "cells": cells, "visited": visited})

    asked = rows.where("asks").select("key", "id").distinct()
    distinct = rows.where("asks").groupBy("key").agg(F.first("v").alias("v"))
    routed = persist_state(
        distinct.mapInPandas(route, "key string, v array<double>, cells array<int>, visited long"), "routed"
    )
    visits = np.zeros_like(count)
    for r in routed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        visits[r["cell"]] = r["count"]
    parts = lambda n: F.element_at(
        F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-n // fit.chunk))]), F.col("cell") + 1
    )
    dealt = entries.withColumn("chunk", F.pmod(F.xxhash64("key"), parts(count)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts(visits) - 1))
    )
    routed = (
        routed.select("key", "v", "visited", F.explode("cells").alias("cell"))
        .withColumn("part", F.pmod(F.xxhash64("key"), parts(visits)).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), parts(count) - 1)))
    )

    def compare(_, entries: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        kinds = ["key", "ids", "score", "visited"]
        if not len(entries) or not len(asks):
            return pd.DataFrame(columns=kinds)
        x = evened(np.stack([np.asarray(v) for v in entries["v"]]))
        ids = entries["ids"].tolist()
        smallest = np.array([own[0] for own in ids])
        norm_x, out = np.sqrt((x * x).sum(1)), []
        k = min(top + 1, len(x))  # one more than asked for: the query's own entry may be among them
        for at in range(0, len(asks), 64):
            part = asks.iloc[at : at + 64]
            y = evened(np.stack([np.asarray(v) for v in part["v"]]))
            norm_y = np.sqrt((y * y).sum(1))
            rough = (y @ x.T) / (norm_y[:, None] * norm_x)
            for j, (key, visited) in enumerate(zip(part["key"], part["visited"])):
                floor = np.partition(rough[j], len(x) - k)[len(x) - k]
                near = np.flatnonzero(rough[j] >= floor - 1e-12)
                # summed in the same order wherever a pair is met
                score = (x[near] * y[j]).sum(1) / (norm_y[j] * norm_x[near])
                for i in np.lexsort((smallest[near], -score))[:k]:
                    out.append((key, ids[near[i]], float(score[i]), visited))
        return pd.DataFrame(out, columns=kinds)

    best = (
        dealt.groupBy("cell", "chunk", "part")
        .cogroup(routed.groupBy("cell", "chunk", "part"))
        .applyInPandas(compare, "key string, ids array<long>, score double, visited long")
    )
    return top_rows(best, asked, top)


def fit_index(vectors: list, fit: IndexFit) -> MultiIndex | None:
    if not vectors:
        return None
    unit = as_unit(vectors)
    half = max(1, unit.shape[1] // 2)
    left = k_means(unit[:, :half], fit.centroids, fit.rounds, fit.seed)
    right = k_means(unit[:, half:], fit.centroids, fit.rounds, fit.seed + 1)
    index = MultiIndex(half, left, right)
    index.share = needed_share(index, unit, fit)
    return index


def needed_share(index: MultiIndex, unit: np.ndarray, fit: IndexFit, top: int = 5) -> float:
    """Share of the sample that its own queries visit until ``recall`` of their neighbours is found."""
    cells = index.cells(unit)
    sizes = np.bincount(cells, minlength=len(index.left) * len(index.right))
    reached = []
    for query in np.random.default_rng(fit.seed).permutation(len(unit))[: fit.trials]:
        near = unit @ unit[query]
        near[query] = -2
        order = list(index.route(unit[query], sizes, len(unit)))
        before = dict(zip(order, np.cumsum(sizes[order])))
        reached += [before[c] / len(unit) for c in cells[np.argsort(-near)[: min(top, len(unit) - 1)]]]
    return float(np.quantile(reached, fit.recall)) if reached else 1.0


def top_rows(best: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """The answers of all queries from the best entries per searched chunk."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.element_at("ids", 1))
    entries = best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1).drop("nth")
    rows = (
        asked.withColumnRenamed("id", "query_id")
        .join(entries, "key")
        .select("query_id", "score", "visited", F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score", "visited")
    )
