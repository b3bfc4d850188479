"""Shards of near equal bytes from a k-d tree over document metadata."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.numbering import number_within
from weftline.session import persist_state

BINS = 1024
#: a group of equal texts of more than 1/LARGE of a shard is placed on its own; hence there
#: are at most shards * LARGE of them
LARGE = 200
#: a cut is fine enough when the bin it falls into holds less than this share of a shard
FINE = 0.001


def text_place(column: str) -> Column:
    """A number that grows with the first bytes of a text; NULL comes before all."""
    first = F.rpad(F.hex(F.encode(F.substring(F.col(column), 1, 6), "UTF-8")), 12, "0")
    return F.coalesce(F.conv(first, 16, 10).cast("double"), F.lit(-1.0))


def number_place(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.coalesce(F.when(F.isnan(value), None).otherwise(value), F.lit(-1.0))


def document_places() -> dict[str, Column]:
    """The metadata dimensions of ``documents``; none of them is NULL."""
    return {
        "source": text_place("source"),
        "lang": text_place("lang"),
        "doc_id": number_place("doc_id"),
        "bytes": F.log2(F.col("_size").cast("double")),
    }


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one for the separator; NULL counts as no text."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@dataclass
class Node:
    """A box of the tree: the shards it still holds and the bytes each is to get."""

    shards: list[int]
    targets: list[float]

    @property
    def left(self) -> int:
        return len(self.shards) // 2


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    places: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    The box of all groups of equal texts is split at the weighted median of its widest
    metadata dimension (widths relative to those of the whole), both halves again, until
    every leaf has the bytes of one shard: ``shards`` of them, or as many as ``target_bytes``
    asks for. Rows equal in a dimension are divided by a hash of the text.

    Equal texts share a shard. A group of over half a shard is divided by a hash of its ids,
    other large groups are first placed whole, the largest first on the emptiest shard, and
    the leaves get as many bytes less. Medians are found on histograms of 1,024 bins per box
    that are refined around the cut: the driver sees bins, never rows. ``slot`` counts from 0
    without gaps. NULL texts weigh one byte, NULL metadata comes first, repeated rows count
    each; an empty table gives no rows.
    """
    places = places or document_places()
    added = ("size", "text_crc32", "shard", "slot")
    keep = [c for c in (keep or docs.columns) if c not in added]
    names = [f"_p{i}" for i in range(len(places))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select("*", byte_size(F.col(text_col)).alias("_size")).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("_id_hash"),
        F.xxhash64(text).alias("_text_hash"),
        F.crc32(text).alias("text_crc32"),
        F.col("_size").alias("size"),
        *[c.alias(n) for n, c in zip(names, places.values())],
    )
    if text_col not in keep:
        placed = persist_state(placed, "placed")
    total = placed.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    share = total / shards

    groups = placed.groupBy("_text_hash").agg(F.sum("size").alias("_bytes"))
    large = groups.where(F.col("_bytes") > share / LARGE).collect() if total else []
    whole, pieces, load = [], [], [0.0] * shards
    for row in sorted(large, key=lambda r: (-r["_bytes"], r["_text_hash"])):
        at = min(range(shards), key=lambda s: (load[s], s))
        if row["_bytes"] > share / 2 or load[at] + row["_bytes"] > share:
            pieces.append((row["_text_hash"], None, int(row["_bytes"] / share * LARGE) + 1))
        else:
            whole.append((row["_text_hash"], at, 1))
            load[at] += row["_bytes"]
    spark = docs.sparkSession
    known = spark.createDataFrame(whole + pieces, "_large long, _at int, _pieces int")
    rows = placed.join(F.broadcast(known), F.col("_text_hash") == F.col("_large"), "left").withColumn(
        "_piece", F.pmod(F.col("_id_hash"), F.coalesce("_pieces", F.lit(1)))
    )
    items = persist_state(
        rows.where(F.col("_at").isNull())
        .groupBy("_text_hash", "_piece")
        .agg(F.sum("size").alias("_bytes"), *[F.min(n).alias(n) for n in names])
        # the tie-break of a cut: a hash in [0, 1)
        .withColumn("_tie", F.shiftrightunsigned(F.xxhash64("_text_hash", "_piece"), 11) / float(1 << 53)),
        "items",
    )
    leaves = split_boxes(items, names, Node(list(range(shards)), [max(share - x, 0.0) for x in load]), share)
    found = persist_state(
        leaves.select(F.col("_text_hash").alias("_h"), F.col("_piece").alias("_q"), F.col("_node").alias("_leaf")),
        "leaves",
    )
    out = (
        rows.join(found, (F.col("_text_hash") == F.col("_h")) & (F.col("_piece") == F.col("_q")), "left")
        .withColumn("shard", F.coalesce("_at", "_leaf").cast("int"))
        .select(
            *[f"_k{i}" for i in range(len(keep))], "_id_hash", "_text_hash", "size", "text_crc32", "shard"
        )
    )
    out = number_within(out, ["shard"], [F.col("_id_hash"), F.col("_text_hash"), F.col("size")], "slot")
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        "size",
        "text_crc32",
        "shard",
        F.col("slot").cast("long").alias("slot"),
    )


def split_boxes(items: DataFrame, names: list[str], root: Node, share: float) -> DataFrame:
    """``items`` with ``_node``: the shard of the leaf each falls into."""
    # a finished box is named by its shard, an open one by -1 - its first shard
    open_boxes = {-1: root} if len(root.shards) > 1 else {}
    state = items.withColumn("_node", F.lit(-1 if open_boxes else root.shards[0]))
    spread: dict[str, float] | None = None
    while open_boxes:
        extent = state.where(F.col("_node") < 0).groupBy("_node").agg(
            F.sum("_bytes").alias("bytes"),
            *[F.min(n).alias(f"lo{n}") for n in names],
            *[F.max(n).alias(f"hi{n}") for n in names],
        )
        extents = {r["_node"]: r for r in extent.collect()}
        if spread is None:
            top = extents.get(-1)
            spread = {n: (top[f"hi{n}"] - top[f"lo{n}"]) or 1.0 if top else 1.0 for n in names}
        cuts = {}
        for node, box in open_boxes.items():
            row = extents.get(node)
            if row is None:
                cuts[node] = {"dim": names[0], "cut": (0.0, 0.0), "done": True}
                continue
            dim = max(names, key=lambda n: (row[f"hi{n}"] - row[f"lo{n}"]) / spread[n])
            wanted, all_of = sum(box.targets[: box.left]), sum(box.targets)
            part = wanted / all_of if all_of else box.left / len(box.shards)
            cuts[node] = {
                "dim": dim, "want": part * row["bytes"], "before": 0.0, "done": False, "value": None,
                "lo": row[f"lo{dim}"], "hi": row[f"hi{dim}"],
            }
        find_cuts(state, cuts, FINE * share)
        node_col = F.col("_node")
        after, opened = node_col, {}
        for node, box in open_boxes.items():
            k, cut = box.left, cuts[node]["cut"]
            halves = (Node(box.shards[:k], box.targets[:k]), Node(box.shards[k:], box.targets[k:]))
            ids = []
            for half in halves:
                ids.append(half.shards[0] if len(half.shards) == 1 else -1 - half.shards[0])
                if len(half.shards) > 1:
                    opened[ids[-1]] = half
            value = F.col(cuts[node]["dim"])
            is_left = (value < cut[0]) | ((value == cut[0]) & (F.col("_tie") < cut[1]))
            after = F.when(node_col == node, F.when(is_left, ids[0]).otherwise(ids[1])).otherwise(after)
        state = persist_state(state.withColumn("_node", after), "boxes")
        open_boxes = opened
    return state


def find_cuts(state: DataFrame, cuts: dict[int, dict], fine: float) -> None:
    """Sets ``cut`` = (value, tie) of every box: what lies below it weighs about ``want``.

    First the value range, then, where one value holds too much, the range of the tie hash
    is divided into bins again and again. Every round is one aggregation over the open boxes
    with at most BINS sums for each of them.
    """
    while todo := {n: c for n, c in cuts.items() if not c["done"]}:
        binned, position = F.lit(None).cast("int"), F.lit(None).cast("double")
        for node, c in todo.items():
            value = F.col(c["dim"])
            at, inside = (value, F.lit(True)) if c["value"] is None else (F.col("_tie"), value == c["value"])
            width = (c["hi"] - c["lo"]) or 1.0
            inside = (F.col("_node") == node) & inside & (at >= c["lo"]) & (at <= c["hi"])
            spot = F.least(F.floor((at - c["lo"]) / width * BINS), F.lit(BINS - 1)).cast("int")
            binned, position = F.when(inside, spot).otherwise(binned), F.when(inside, at).otherwise(position)
        sums = (
            state.where(F.col("_node").isin(list(todo)))
            .select("_node", "_bytes", binned.alias("_bin"), position.alias("_at"))
            .where(F.col("_bin").isNotNull())
            .groupBy("_node", "_bin")
            .agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi"))
            .collect()
        )
        by_node = defaultdict(list)
        for r in sums:
            by_node[r["_node"]].append(r)
        for node, c in todo.items():
            bins = sorted(by_node[node], key=lambda r: r["_bin"])
            for i, r in enumerate(bins):
                if c["before"] + r["b"] >= c["want"] or i == len(bins) - 1:
                    break
                c["before"] += r["b"]
            small, one = r["b"] <= fine or r["n"] == 1, r["lo"] == r["hi"]
            if small or (one and c["value"] is not None):
                # the nearer edge of this bin
                later = c["want"] - c["before"] > r["b"] / 2
                edge = (bins[i + 1]["lo"] if i + 1 < len(bins) else just_above(r["hi"])) if later else r["lo"]
                c["cut"] = (edge, 0.0) if c["value"] is None else (c["value"], edge)
                c["done"] = True
            elif one:
                c |= {"value": r["lo"], "lo": 0.0, "hi": 1.0}
            else:
                c |= {"lo": r["lo"], "hi": r["hi"]}


def just_above(value: float) -> float:
    import math

    return math.nextafter(value, math.inf)
