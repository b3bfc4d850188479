"""Connected components and linking inside hash buckets, without pairs of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import persist_state

#: members compared at once: so many outsiders with so many of their crowd
OUTSIDERS, CROWD = 512, 2048
#: links that are closed by one task
AT_ONCE = 1 << 20


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node in ``links(a, b)``.

    Alternates large-star and small-star steps until nothing changes: a logarithmic number
    of rounds, each with one aggregation (combined map-side) and one join over the links.
    """
    edges = persist_state(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = persist_state(large.distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = persist_state(
            small.where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lowest.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        tops.select("node", F.col("node").alias("component"))
    )


def close_links(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Like ``connected_components``; up to ``at_once`` links are closed by one task, without rounds."""
    links = persist_state(links, "links")
    if links.count() > at_once:
        return connected_components(links)
    return persist_state(links.coalesce(1).mapInArrow(_close, "node long, component long"), "components")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(batches)
    a, b = (np.concatenate([np.zeros(0, np.int64), *[x.column(i).to_numpy() for x in batches]]) for i in range(2))
    apart = a != b
    nodes, ends = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
    top = list(range(len(nodes)))
    # the nodes are in order, so the smaller number of two is the smaller node
    for x, y in zip(*ends.reshape(2, -1).tolist()):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        top[max(x, y)] = min(x, y)
    for x in range(len(top)):
        top[x] = top[top[x]]
    columns = [pa.array(nodes, pa.int64()), pa.array(nodes[np.array(top, np.int64)], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["node", "component"])


def link_buckets(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame, DataFrame], DataFrame],
    radius: float,
) -> DataFrame:
    """Links ``a``, ``b`` that connect all members of buckets that belong together.

    buckets: ``key``, ``id`` of all members of all buckets.
    verify(pairs): all pairs ``a``, ``b`` with bounds ``low``, ``high`` of their distance (a
    metric); both are equal for a pair that may lie within ``radius``, and such are links.
    compare(outsiders, crowd): both have ``block``, ``id``, ``own`` (a component); links
    between outsiders and others of their block that join different components.

    Buckets of two are a pair. In a larger bucket every member is compared with one pivot: the
    member that shares most buckets. Stars join most of what belongs together. What is left
    are members outside their pivot's component: they are compared with all of their crowd
    that the triangle inequality over the pivot doesn't rule out. Crowds that share members
    are taken together, so no pair is met once for each bucket, and are cut into blocks of
    OUTSIDERS by CROWD members. Nothing is dropped, and pairs are never rows.
    """
    sums = persist_state(
        buckets.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        .where("n > 1 AND lo < hi"),
        "buckets",
    )
    members = persist_state(buckets.join(sums.where("n > 2").select("key", "n"), "key"), "members")
    fame = members.groupBy("id").agg(F.sum("n").alias("fame"))
    pivots = (
        members.join(fame, "id").groupBy("key").agg(F.max(F.struct("fame", F.col("id").alias("pivot"))).alias("p"))
        .select("key", "p.pivot")
    )
    spokes = persist_state(members.join(pivots, "key").select("key", "id", "pivot"), "spokes")
    pairs = sums.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    pairs = pairs.union(spokes.where("id <> pivot").select(*ordered("id", "pivot"))).distinct()
    checked = persist_state(verify(pairs), "checked")
    links = checked.where((F.col("low") == F.col("high")) & (F.col("low") <= radius)).select("a", "b")
    if spokes.isEmpty():
        return links
    labels = connected_components(links)
    left = persist_state(leftover(spokes, checked, labels, radius), "left")
    if left.isEmpty():
        return links
    return links.union(compare(*crowd_blocks(left)))


def crowd_blocks(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outsiders and crowds of ``left(key, id, own, same)``, dealt to the blocks where they meet."""
    least = left.groupBy("key").agg(F.min("id").alias("least"))
    shared = left.join(least, "key").select(F.col("id").alias("a"), F.col("least").alias("b"))
    groups = connected_components(shared).withColumnsRenamed({"node": "id", "component": "crowd"})
    each = left.groupBy("id").agg(F.first("own").alias("own"), F.min("same").alias("same"))
    # a crowd of one is a key whose other members were ruled out
    each = persist_state(each.join(groups, "id"), "crowds")
    size = each.groupBy("crowd").agg(
        F.ceil(F.count_if(~F.col("same")) / OUTSIDERS).cast("int").alias("rows"),
        F.ceil(F.count("*") / CROWD).cast("int").alias("columns"),
    )
    each = each.join(size, "crowd")
    row = F.pmod(F.xxhash64("id", F.lit(1)), F.col("rows")).cast("int")
    column = F.pmod(F.xxhash64("id", F.lit(2)), F.col("columns")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    name = F.xxhash64("crowd", "row", "column").alias("block")
    outsiders = each.where("NOT same").withColumn("row", row).withColumn("column", every("columns"))
    crowd = each.withColumn("column", column).withColumn("row", every("rows"))
    return outsiders.select(name, "id", "own"), crowd.select(name, "id", "own")


def ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def leftover(spokes: DataFrame, checked: DataFrame, labels: DataFrame, radius: float) -> DataFrame:
    """``key``, ``id``, ``own`` (component), ``same`` (as the pivot's) of members of buckets that
    hold several components and may still have links across.
    """
    labels = persist_state(labels, "labels")
    at_pivot = F.col("id") == F.col("pivot")
    named = (
        spokes.select("*", *ordered("id", "pivot"))
        .join(checked, ["a", "b"], "left")
        .withColumn("low", F.when(at_pivot, 0.0).otherwise(F.col("low")))
        .withColumn("high", F.when(at_pivot, 0.0).otherwise(F.col("high")))
        .drop("a", "b")
        .join(labels.withColumnsRenamed({"node": "id", "component": "own"}), "id", "left")
        .join(labels.withColumnsRenamed({"node": "pivot", "component": "to"}), "pivot", "left")
        .withColumn("own", F.coalesce("own", "id"))
        .withColumn("same", F.col("own") == F.coalesce("to", "pivot"))
    )
    named = persist_state(named, "named")
    per_key = named.groupBy("key").agg(
        # the ring: the nearest member outside the pivot's component
        F.min(F.when(~F.col("same"), F.col("low"))).alias("ring"),
    )
    # the pivot has met all; of its component only those stay that reach out to the ring
    reach = ~F.col("same") | (~at_pivot & (F.col("high") + radius >= F.col("ring")))
    return (
        named.join(per_key.where("ring IS NOT NULL"), "key")
        .where(reach)
        .select("key", "id", "own", "same")
    )
