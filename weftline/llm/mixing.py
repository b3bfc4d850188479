"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.hashing import HASH_BITS, hash60
from weftline.llm.numbering import rank_values
from weftline.session import persist_state

WORD = r"[^\x20\x09-\x0D]+"
CUT_BITS = 12


def word_count(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """Water-filling of sources.

    weights:    given to the sources in the order of their names (by code point, NULL last),
                repeating
    max_epochs: no source is taken more often than this
    share:      size of the mix as a share of all sizes
    seed:       of the draw of fractional repetitions
    """

    weights: tuple[int, ...] = (5, 2, 1)
    max_epochs: int = 3
    share: float = 1.0
    seed: int = 7

    def targets(self, sources: DataFrame) -> DataFrame:
        """``sources(source, source_size)`` with ``weight`` and ``target``.

        Level L with target = min(cap, L * weight) is found by clamping: sources above their
        cap are set to it, the rest shares what is left by weight, until none is above. The
        driver holds the level only; every step is one aggregation.
        """
        n = len(self.weights)
        weight = F.element_at(F.array(*map(F.lit, self.weights)), (F.col("_pos") % n + 1).cast("int"))
        ranked = persist_state(
            rank_values(sources, "source", "_pos")
            .withColumn("weight", weight)
            .withColumn("_cap", F.col("source_size") * self.max_epochs)
            .drop("_pos"),
            "sources",
        )
        first = ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
        total = (first["t"] or 0) * self.share
        level = total / first["w"] if first["w"] else 0.0
        while True:
            above = F.col("_cap") < F.lit(level) * F.col("weight")
            row = ranked.agg(
                F.sum(F.when(above, F.col("_cap"))).alias("caps"),
                F.sum(F.when(~above, F.col("weight"))).alias("w"),
            ).first()
            if not row["w"]:
                break
            higher = (total - (row["caps"] or 0)) / row["w"]
            if higher <= level:
                break
            level = higher
        share = F.lit(level) * F.col("weight")
        return ranked.withColumn(
            "target", F.when(F.col("_cap") < share, F.col("_cap").cast("double")).otherwise(share)
        ).drop("_cap")


def mix_plan(docs: DataFrame, mix: Mix, id_col="doc_id", text_col="text", source_col="source"):
    """Per source: target, whole repetitions and the cut of the fractional one.

    Inside a source documents are ordered by a seeded hash of their id. The documents before
    the cut get one repetition more; the cut is the last one that stays below the target. It
    is located on the sums of 4,096 hash ranges, then inside the one range that holds it. The
    gap that is left gets the one later document whose size comes closest to it.
    """
    draw = hash60(F.coalesce(F.col(id_col).cast("string"), F.lit("")), mix.seed)
    sized = persist_state(
        docs.select(
            F.col(source_col).alias("source"),
            draw.alias("_draw"),
            F.shiftright(draw, HASH_BITS - CUT_BITS).cast("int").alias("_range"),
            word_count(F.col(text_col)).alias("_size"),
        ),
        "sizes",
    )
    ranges = persist_state(
        sized.groupBy("source", "_range").agg(F.sum("_size").alias("_size")), "ranges"
    )
    sources = mix.targets(ranges.groupBy("source").agg(F.sum("_size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = persist_state(
        sources.withColumn("_whole", whole.cast("long")).withColumn(
            "_rest", F.col("target") - F.col("_whole") * F.col("source_size")
        ),
        "targets",
    )
    by_range = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keyed = sources.select(F.col("source").alias("_s"), "_rest")
    cut_range = (
        ranges.withColumn("_before", F.coalesce(F.sum("_size").over(by_range), F.lit(0)))
        .join(keyed, F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_size")))
        .select("_s", F.col("_range").alias("_r"), (F.col("_rest") - F.col("_before")).alias("_left"))
    )
    hit = persist_state(cut_range, "cuts")
    by_draw = Window.partitionBy("source").orderBy("_draw", "_size")
    inside = by_draw.rowsBetween(Window.unboundedPreceding, -1)
    in_cut = sized.join(
        hit, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    ).withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    taken = in_cut.where(F.col("_before") + F.col("_size") <= F.col("_left"))
    cuts = taken.groupBy("source").agg(F.max("_draw").alias("_cut"))
    ties = (
        taken.alias("t")
        .join(cuts.alias("c"), F.expr("t.source <=> c.source AND t._draw = c._cut"))
        .groupBy(F.col("t.source").alias("source"), F.col("c._cut").alias("_cut"))
        .agg(F.count("*").alias("_ties"))
    )
    used = taken.groupBy("source").agg(F.sum("_size").alias("_used"))
    start = F.shiftleft(F.col("_r").cast("long"), HASH_BITS - CUT_BITS)
    cut = persist_state(
        sources.alias("p")
        .join(hit.alias("h"), F.expr("p.source <=> h._s"), "left")
        .join(ties.alias("k"), F.expr("p.source <=> k.source"), "left")
        .join(used.alias("u"), F.expr("p.source <=> u.source"), "left")
        .select(
            F.col("p.source").alias("_source"),
            "p.source_size",
            "p.target",
            "p._whole",
            # before the cut range all are taken; without a cut range none is
            F.coalesce(F.col("k._cut"), start - 1, F.lit(-1)).alias("_cut"),
            F.coalesce(F.col("k._ties"), F.lit(0)).alias("_ties"),
            (F.col("h._left") - F.coalesce(F.col("u._used"), F.lit(0))).alias("_gap"),
        ),
        "cut",
    )
    # the document behind the cut that fills the gap best
    miss = F.abs(F.col("_size") - F.col("_gap"))
    fill = (
        sized.join(cut.where("_gap > 0"), F.col("source").eqNullSafe(F.col("_source")))
        .where((F.col("_draw") > F.col("_cut")) & (miss < F.col("_gap")))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("m"), F.col("_draw"), F.col("_size"))).alias("f"))
        .select(F.col("source").alias("_fs"), F.col("f._draw").alias("_fill"), F.col("f._size").alias("_fill_size"))
    )
    return persist_state(
        cut.join(fill, F.col("_source").eqNullSafe(F.col("_fs")), "left").drop("_fs", "_gap"), "mixplan"
    )


def mix_sources(
    docs: DataFrame, mix: Mix = Mix(), id_col="doc_id", text_col="text", source_col="source"
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``repeats`` (0 to max_epochs).

    A NULL text has size 0. Rows of one id share a place in the order; where the cut falls
    among them they are told apart by size, so repeated rows cost no accuracy. An empty table
    gives no rows. Columns of ``docs`` with the added names are replaced.
    """
    plan = mix_plan(docs, mix, id_col, text_col, source_col)
    added = ("size", "source_size", "target", "repeats")
    kept = [c for c in docs.columns if c not in added]
    rows = (
        docs.select(
            *kept,
            word_count(F.col(text_col)).alias("size"),
            F.col(source_col).alias("_src"),
            hash60(F.coalesce(F.col(id_col).cast("string"), F.lit("")), mix.seed).alias("_draw"),
        )
        .join(plan, F.col("_src").eqNullSafe(F.col("_source")))
        .withColumn("_at_cut", (F.col("_draw") == F.col("_cut")) & (F.col("_ties") > 0))
        .withColumn("_tied", F.col("_at_cut") | F.coalesce(F.col("_draw") == F.col("_fill"), F.lit(False)))
    )
    clear = rows.where(~F.col("_tied")).withColumn(
        "repeats", F.col("_whole") + (F.col("_draw") <= F.col("_cut")).cast("long")
    )
    near = F.when(F.col("_at_cut"), F.col("size")).otherwise(F.abs(F.col("size") - F.col("_fill_size")))
    order = Window.partitionBy("_src", "_draw").orderBy(near)
    quota = F.when(F.col("_at_cut"), F.col("_ties")).otherwise(1)
    tied = (
        rows.where("_tied")
        .withColumn("_nth", F.row_number().over(order))
        .withColumn("repeats", F.col("_whole") + (F.col("_nth") <= quota).cast("long"))
        .drop("_nth")
    )
    return clear.unionByName(tied).select(*kept, *added)
