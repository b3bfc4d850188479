"""A Merkle manifest of a dataset: a tree per source, a tree over sources, a proof per document.

The slot pivot: the children of a parent are spread into ``fanout`` columns by conditional
aggregates; concatenating all columns and hashing gives the parent, concatenating all but the
own slot's column gives the siblings that a proof lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.ordered import positions
from weftline.session import persist_state

FANOUT = 3
STOREY = 6  # levels of a tree that one shuffle serves: blocks of fanout ** STOREY nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts; NULL parts add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for NULL, else byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*[encoded(f) for f in fields])


def pivot_storey(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes(tree, pos, members, node)`` with their path through ``levels`` levels.

    Adds ``block`` (the ancestor's position), ``top`` (its digest) and ``path``: per level the
    digests left and right of the own slot. All levels of a block live in one partition: its
    runs are windows that only narrow the key (tree, block), so the rows are shuffled and
    sorted once. A tree that is down to one node passes through unchanged.
    """
    span = [fanout**k for k in range(levels + 1)]
    group = lambda size: F.floor(F.col("pos") / F.lit(size)).cast("long")
    out = nodes.withColumn("block", group(span[levels])).withColumn("top", F.col("node"))
    out = out.withColumns({f"_g{k}": group(span[k]) for k in range(1, levels)}).withColumn(f"_g{levels}", F.col("block"))
    steps = []
    for k in range(levels):
        slot = F.pmod(group(span[k]), F.lit(fanout))
        run = Window.partitionBy("tree", "block", *[f"_g{j}" for j in range(levels - 1, k, -1)])
        slots = [F.max(F.when(slot == s, F.col("top"))).over(run) for s in range(fanout)]
        names = [f"_s{k}_{s}" for s in range(fanout)]
        out = out.withColumns(dict(zip(names, slots)))
        more = F.ceil(F.col("members") / F.lit(span[k])) > 1
        left = F.concat_ws("", *[F.when(slot > s, F.col(c)) for s, c in enumerate(names)])
        right = F.concat_ws("", *[F.when(slot < s, F.col(c)) for s, c in enumerate(names)])
        steps.append(F.when(more, F.struct(left.alias("left"), right.alias("right"))))
        out = out.withColumn("top", F.when(more, digest(*[F.col(c) for c in names])).otherwise(F.col("top")))
    path = F.filter(F.array(*steps), lambda step: step.isNotNull()).cast(PATH)
    return out.withColumn("path", path).select(*nodes.columns, "block", "top", "path")


def climb(nodes: DataFrame, fanout: int = FANOUT, storey: int = STOREY) -> list[DataFrame]:
    """The storeys over ``nodes(tree, pos, members, node)``, as stored tables, lowest first.

    Blocks of a storey are the nodes of the next one. The driver sees the size of the largest
    tree only.
    """
    size = nodes.agg(F.max("members")).first()[0] or 1
    floors = []
    while True:
        levels = 1
        while levels < storey and fanout**levels < size:
            levels += 1
        floors.append(persist_state(pivot_storey(nodes, fanout, levels), "storey"))
        size = -(-size // fanout**levels)
        if size <= 1:
            return floors
        nodes = floors[-1].groupBy("tree", F.col("block").alias("pos")).agg(
            F.ceil(F.max("members") / F.lit(fanout**levels)).alias("members"), F.max("top").alias("node")
        )


def hand_down(floors: list[DataFrame], rest: DataFrame | None = None) -> DataFrame:
    """The lowest storey's nodes with ``subroot`` of their tree and ``path`` from leaf to root.

    ``rest(_tree, root, _rest)`` continues the paths above the subroots. Every storey hands
    its paths to the blocks below, so the long upper parts are copied once per block until
    the last step.
    """
    above = floors[-1].withColumnRenamed("top", "subroot").drop("block")
    if rest is None:
        above = above.withColumn("root", F.col("subroot"))
    else:
        above = above.join(rest, F.col("tree").eqNullSafe(F.col("_tree")))
        above = above.withColumn("path", F.concat("path", "_rest")).drop("_tree", "_rest")
    for low in reversed(floors[:-1]):
        upper = above.select(
            F.col("tree").alias("_t"), F.col("pos").alias("_b"), "subroot", "root", F.col("path").alias("_rest")
        )
        above = (
            low.join(upper, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b")))
            .withColumn("path", F.concat("path", "_rest"))
            .drop("_t", "_b", "_rest", "block", "top")
        )
    return above


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def merkle_manifest(
    docs: DataFrame,
    tampered_text: Column | None = None,
    fanout: int = FANOUT,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    text_col: str = "text",
    storey: int = STOREY,
) -> DataFrame:
    """One row per document: ``<id_col>, leaf, subroot, root, path, tampered_leaf``.

    A leaf is the digest of ``fields``, each with its length in front (NULL: ``-``). Leaves of a
    source stand in the order of their ids; every ``fanout`` consecutive nodes become their
    digest while more than one remains: ``subroot``. Subroots in the order of their sources
    (NULL first, by bytes) give ``root`` the same way. ``path`` is the proof: per level up to the
    root the digests left and right of the own one. ``tampered_text`` is what the text turned
    into since; its leaf is ``tampered_leaf``, to be checked against ``path`` (without it the
    same as ``leaf``).

    Rows without id come first in their source; repeated ids stand in the order of their
    leaves, so equal rows share all digests but not the path. Rows without source are a source
    of their own. Empty texts are leaves like others. Other columns, whatever their names, are
    not read. An empty table gives no rows. Only digests are shuffled, never texts; a source
    that holds most rows is spread over ranges of ids, then blocks of ``fanout ** storey``.
    """
    own = [F.col(c) for c in fields]
    now = [F.col(c) if c != text_col or tampered_text is None else tampered_text for c in fields]
    leaves = persist_state(
        docs.select(
            F.col(id_col).alias("_id_of"),
            F.col(source_col).alias("tree"),
            leaf_digest(own).alias("node"),
            leaf_digest(now).alias("tampered_leaf"),
        ),
        "leaves",
    )
    placed = positions(leaves, "tree", [F.col("_id_of").asc_nulls_first(), F.col("node")])
    floors = climb(placed, fanout, storey)
    subroots = floors[-1].where("pos = 0").select(
        F.col("tree").alias("_tree"), F.col("top").alias("node"), F.lit(0).alias("tree")
    )
    subroots = positions(persist_state(subroots, "subroots"), "tree", [F.col("_tree").asc_nulls_first()])
    rest = hand_down(climb(subroots, fanout, storey)).select("_tree", "root", F.col("path").alias("_rest"))
    return hand_down(floors, persist_state(rest, "top")).select(
        F.col("_id_of").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", "tampered_leaf"
    )


def verify_manifest(manifest: DataFrame) -> DataFrame:
    """Folds every tampered leaf up its proof: ``proof_sha256``, ``folded_root``, ``verified``."""
    out = manifest.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn(
        "folded_root", fold_path(F.col("tampered_leaf"), F.col("path"))
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
