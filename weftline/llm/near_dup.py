"""Near-duplicate documents by banded SetSketch registers, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import connected_components, link_buckets
from weftline.llm.setsketch import _multipliers, jaccard_estimate, registers_of
from weftline.llm.words import mix64, shingle_sets
from weftline.llm.numbering import free_name
from weftline.session import persist_state

#: a pair with Jaccard similarity 0.8 misses all bands once in seven million
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: the estimate's standard deviation is at most 0.036 (0.029 at 0.8): a pair of similarity 0.8
#: is estimated further away than this less than once in 10^8
SLACK = 0.16
#: bits of the table that sorts out most documents before their sets are made
TABLE_BITS = 23


def set_id(elements: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    with np.errstate(over="ignore"):
        total = elements.sum(dtype=np.uint64) ^ mix64(mix64(elements).sum(dtype=np.uint64).reshape(1))[0]
    return int(total.astype(np.int64))


def _sketcher(words: int):
    schema = pa.schema(
        [("doc", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("sketch", pa.binary())]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _multipliers(REGISTERS)
        for batch in batches:
            size, name, body = [], [], []
            for elements in shingle_sets(batch.column(1), words):
                size.append(len(elements))
                name.append(set_id(elements) if len(elements) else None)
                body.append(registers_of(elements, REGISTERS, tables).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(body, pa.binary())],
                schema=schema,
            )

    return sketch


def _set_reader(words: int, table):
    """Sets of the documents whose place in the bit table is marked."""
    schema = pa.schema([("id", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = table.value[batch.column(2).to_numpy()]
            texts = batch.column(1).filter(pa.array(marked))
            for elements in shingle_sets(texts, words):
                if len(elements):
                    body = pa.array([elements.astype(np.int64)], schema.field(1).type)
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(elements)], pa.int64()), body], schema=schema)

    return read


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, estimate) of (a, b, n_a, n_b, sketch_a, sketch_b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("estimate", pa.float64())])
    for batch in batches:
        size_a, size_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        x, y = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS) for c in (4, 5)
        )
        found = pa.array(jaccard_estimate(x, y, size_a, size_b), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], schema=schema)


def bit_table(places: DataFrame) -> np.ndarray:
    """Which of 2^TABLE_BITS places occur in ``places(place)``: a table of fixed size."""
    rows = (
        places.groupBy(F.bitmap_bucket_number("place").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << TABLE_BITS, bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        # bucket 1 holds the numbers 1 to 32768
        first = (r["part"] - 1) * 32768 + 1
        room = out[first : first + len(bits)]
        room |= bits[: len(room)].astype(bool)
    return out


def band_keys(sketch: Column) -> list[Column]:
    return [F.xxhash64(F.lit(j), F.substring(sketch, 2 * ROWS * j + 1, 2 * ROWS)) for j in range(BANDS)]


def close_pairs(x: list[np.ndarray], y: list[np.ndarray], similar: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets (distinct hashes) with at least the similarity, by counting common hashes."""
    of_x, of_y = (np.repeat(np.arange(len(s)), [len(e) for e in s]) for s in (x, y))
    all_x, all_y = np.concatenate(x), np.concatenate(y)
    order_x, order_y = np.argsort(all_x, kind="stable"), np.argsort(all_y, kind="stable")
    sorted_x, sorted_y = all_x[order_x], all_y[order_y]
    both = np.intersect1d(sorted_x, sorted_y)
    common = np.zeros((len(x), len(y)), np.int32)
    spans = [np.searchsorted(s, both, side) for s in (sorted_x, sorted_y) for side in ("left", "right")]
    for a, b, c, d in zip(*(v.tolist() for v in spans)):
        common[of_x[order_x[a:b]][:, None], of_y[order_y[c:d]]] += 1
    sizes = np.array([len(e) for e in x])[:, None] + np.array([len(e) for e in y])
    return np.nonzero(similar[1] * common >= similar[0] * (sizes - common))


def crossing(a, own_a, b, own_b, pairs) -> pa.Table:
    """One link for each outsider and other component."""
    found = {}
    for i, j in zip(*pairs):
        if own_a[i] != own_b[j]:
            found.setdefault((a[i], own_b[j]), (a[i], b[j]))
    rows = list(zip(*found.values())) or [[], []]
    return pa.table({"a": pa.array(rows[0], pa.int64()), "b": pa.array(rows[1], pa.int64())})


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    similar: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` per row of ``docs``.

    Documents are linked when their sets of distinct ``words``-word shingles (lower-cased A-Z,
    words between ASCII white space) have a Jaccard similarity of at least ``similar``;
    components are closed over links and named by their smallest id. ``kept`` is true for
    the row that names its component.

    Equal sets are one node (found by aggregation, so copies never meet in a task). Nodes that
    share a band of SetSketch registers are candidates; their similarity is first estimated
    by maximum likelihood from both sketches and then computed from the full sets. Buckets
    are handled by ``link_buckets``: large ones by pivots instead of pairs.

    Fewer words than a shingle: the whole sequence is one. No words, or NULL text: no
    shingles, linked with nothing. Rows without id are kept and have no component. Of rows
    with the same id each keeps its own size; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketched = persist_state(
        rows.mapInArrow(_sketcher(words), "doc long, n long, id long, sketch binary"), "sketches"
    )
    classes = persist_state(
        sketched.where("n > 0 AND doc IS NOT NULL")
        .groupBy("id")
        .agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )

    buckets = classes.select(F.explode(F.array(*band_keys(F.col("sketch")))).alias("key"), "id")
    side = classes.select("id", "n", "sketch")

    least = similar[0] / similar[1] - SLACK
    place = F.pmod(F.xxhash64("doc"), F.lit((1 << TABLE_BITS) - 1)) + 1

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(classes.select("id", "doc"), "id")
        table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(place.alias("place"))))
        sets = (
            rows.where("doc IS NOT NULL")
            .select("doc", "text", place.alias("place"))
            .mapInArrow(_set_reader(words, table), "id long, elements array<long>")
        )
        return persist_state(sets.groupBy("id").agg(F.first("elements").alias("elements")), "sets")

    def compare(outsiders: DataFrame, crowd: DataFrame) -> DataFrame:
        sets = sets_of(crowd.select("id").union(outsiders.select("id")).distinct())

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            pairs = ((), ())
            a, b = x["id"].to_pylist(), y["peer"].to_pylist()
            if a and b:
                bodies = ([v.values.to_numpy() for v in column] for column in (x["elements"], y["others"]))
                pairs = close_pairs(*bodies, similar)
            return crossing(a, x["own"].to_pylist(), b, y["whose"].to_pylist(), pairs)

        return (
            outsiders.join(sets, "id").groupBy("block")
            .cogroup(crowd.toDF("at", "peer", "whose").join(sets.toDF("peer", "others"), "peer").groupBy("at"))
            .applyInArrow(meet, "a long, b long")
        )

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
        both = both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        guessed = persist_state(both.mapInArrow(_estimate, "a long, b long, estimate double"), "guessed")
        close = guessed.where(F.col("estimate") >= least)
        sets = sets_of(close.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        exact = (
            close.select("a", "b")
            .join(sets.toDF("a", "x"), "a")
            .join(sets.toDF("b", "y"), "b")
            .select("a", "b", ((union - common) / union).alias("low"))
            .withColumn("high", F.col("low"))
        )
        far = guessed.where(F.col("estimate") < least).select(
            "a", "b",
            F.greatest(1 - F.col("estimate") - SLACK, F.lit(0.0)).alias("low"),
            F.least(1 - F.col("estimate") + SLACK, F.lit(1.0)).alias("high"),
        )
        return exact.union(far)

    radius = (similar[1] - similar[0]) / similar[1]  # distances are such ratios too: the same number
    links = link_buckets(buckets, verify, compare, radius)
    labels = connected_components(links)
    named = classes.join(labels, F.col("id") == F.col("node"), "left").select(
        "id", "doc", F.coalesce("component", "id").alias("label")
    )
    first = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = persist_state(named.join(first, "label").select("id", "component_id"), "named")
    return sketched.join(named, "id", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every group of near duplicates.

    A document is told by a 64-bit hash of its id and text: rows that repeat both are one, rows
    that share an id but not the text are judged by their texts, and so are rows without id.
    Of a group the one with the smallest id stays (of equal or missing ids the smallest hash,
    missing last). Columns of any name are kept.
    """
    key, copies, other = (free_name(docs, name) for name in ("document", "copies", "kept"))
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = near_duplicates(keyed, words, id_col=key, text_col=text_col)
    members = found.groupBy("doc_id").agg(F.min("component_id").alias("group"), F.count("*").alias("n"))
    named = keyed.select(F.col(key).alias("doc_id"), F.col(id_col).alias("name")).distinct()
    order = F.struct(F.col("name").isNull(), "name", "doc_id", "n")
    first = members.join(named, "doc_id").groupBy("group").agg(F.min(order).alias("f"))
    kept = persist_state(first.select(F.col("f.doc_id").alias(other), F.col("f.n").alias(copies)), "kept")
    rows = keyed.join(kept, F.col(key) == F.col(other))
    single = rows.where(F.col(copies) == 1).select(*docs.columns)
    repeated = rows.where(F.col(copies) > 1).dropDuplicates([key]).select(*docs.columns)
    return single.unionByName(repeated)
