"""Exact order statistics without a global sort, a shuffle by value or an unbounded group.

Quantiles are found by bracketing selection: count rows per coarse bin (combined map-side),
find the bins that hold the wanted ranks, cut those that hold too many rows into finer bins
around the rank, and order only what is left.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.columns import all_of
from weftline.functions.hashing import HASH_BITS
from weftline.session import persist_state

BINS_PER_E_FOLD = 256.0
SUB_BINS = 4096
ORDERED_ROWS = 100_000  # a range with more rows is cut again before its values are ordered


def _value_bin(value: Column) -> Column:
    """A monotone map from doubles to integers with at most about 750,000 distinct results."""
    magnitude = F.floor((F.ln(F.abs(value)) + F.lit(750.0)) * F.lit(BINS_PER_E_FOLD))
    return F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude).cast("bigint")


def _same(left: str, right: str, columns: list[str]) -> Column:
    return all_of([F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _held_out(counts: DataFrame, by: list[str], bin_key: list[str], leave_out: tuple[str, int] | None) -> DataFrame:
    """Bin counts per group; with folds, per group and held-out fold, by adding the other folds' bins.

    Every bin keeps the limits of all its values, so all held-out folds share their ranges.
    """
    if not leave_out:
        return counts
    fold, folds = leave_out
    outside = F.sum(F.when(F.col("held_out") != F.col(fold), F.col("_bn")).otherwise(0))
    spread = counts.withColumn("held_out", F.explode(F.array(*[F.lit(i) for i in range(-1, folds)])))
    return (
        spread.groupBy(*by, "held_out", *bin_key)
        .agg(outside.alias("_bn"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    )


def _hits(bins: DataFrame, group: list[str], inside: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Bins that hold a wanted rank, with the number of rows before (``_before``) and in the group (``_rows``)."""
    keyed = W.partitionBy(*group, *inside)
    upto = keyed.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("_before", F.col("_start") + F.sum("_bn").over(upto) - F.col("_bn"))
    ranks = F.array(*[at for pair in _ranks(probabilities).values() for at in pair])
    return bins.where(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_bn"))))


def _ranks(probabilities: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    position = {n: (F.col("_rows") - 1) * F.lit(float(p)) for n, p in probabilities.items()}
    return {n: (F.floor(p), F.ceil(p)) for n, p in position.items()}


def bracket(
    rows: DataFrame, probabilities: dict[str, float], by: list[str], leave_out: tuple[str, int] | None, ordered_rows: int
) -> DataFrame:
    """Ranges of values that hold the wanted ranks, each of one value or at most ``ordered_rows`` rows.

    ``rows(by, [fold], _value)``. Columns of the result: group, ``_bin0`` (the coarse bin), ``_lo``
    and ``_hi`` (the limits), ``_n`` (rows of all folds), ``_bn`` (rows that count for the
    group), ``_before``, ``_rows``. Only counts per bin are shuffled. Each round cuts a range
    into SUB_BINS between its least and largest value, so doubles are told apart in a few.
    """
    base = [*by, leave_out[0]] if leave_out else by
    group = [*by, "held_out"] if leave_out else by
    limits = [F.count(F.lit(1)).alias("_bn"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")]
    coarse = persist_state(
        rows.groupBy(*base, _value_bin(F.col("_value")).alias("_bin")).agg(*limits), "bins"
    )
    sizes = coarse.groupBy(*by, "_bin").agg(F.sum("_bn").alias("_n")) if leave_out else None
    bins = _held_out(coarse, by, ["_bin"], leave_out)
    bins = bins.withColumn("_rows", F.sum("_bn").over(W.partitionBy(*group))).withColumn("_start", F.lit(0).cast("bigint"))
    found = _hits(bins, group, [], probabilities).withColumn("_bin0", F.col("_bin"))
    if leave_out:
        found = found.alias("f").join(sizes.alias("s"), _same("f", "s", [*by, "_bin"])).select("f.*", "s._n")
    else:
        found = found.withColumn("_n", F.col("_bn"))
    columns = [*group, "_bin0", "_lo", "_hi", "_n", "_bn", "_before", "_rows"]
    done: list[DataFrame] = []
    while True:
        found = persist_state(found.select(*columns), "brackets")
        wide = (F.col("_n") > ordered_rows) & (F.col("_lo") < F.col("_hi"))
        done.append(found.where(~wide))
        active = found.where(wide)
        if active.isEmpty():
            break
        ranges = active.select(*by, "_bin0", "_lo", "_hi").distinct()
        inside = F.floor((F.col("r._value") - F.col("a._lo")) / (F.col("a._hi") - F.col("a._lo")) * SUB_BINS)
        cut = (
            in_ranges(rows, ranges, by)
            .groupBy(
                *[F.col(f"r.{c}").alias(c) for c in base],
                "a._bin0",
                F.col("a._lo").alias("_of"),
                F.least(inside, F.lit(SUB_BINS - 1)).alias("_bin"),
            )
            .agg(
                F.count(F.lit(1)).alias("_bn"), F.min("r._value").alias("_lo"), F.max("r._value").alias("_hi")
            )
        )
        cut = persist_state(cut, "bins")
        key = ["_bin0", "_of", "_bin"]
        fine = _held_out(cut, by, key, leave_out)
        if leave_out:
            sizes = cut.groupBy(*by, *key).agg(F.sum("_bn").alias("_n"))
            fine = fine.alias("f").join(sizes.alias("s"), _same("f", "s", [*by, *key])).select("f.*", "s._n")
        else:
            fine = fine.withColumn("_n", F.col("_bn"))
        outer = active.select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
            F.col("_bin0").alias("_o_bin0"), F.col("_lo").alias("_o_lo"), F.col("_before").alias("_start"), "_rows",
        )
        same = (F.col("_bin0") == F.col("_o_bin0")) & (F.col("_of") == F.col("_o_lo"))
        for i, c in enumerate(group):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        found = _hits(fine.join(outer, same), group, ["_bin0", "_of"], probabilities)
    return functools.reduce(DataFrame.unionByName, done)


def in_ranges(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows (``r``) with the range (``a``) of their group that holds their value."""
    held = rows.withColumn("_bin0", _value_bin(F.col("_value")))
    on = _same("r", "a", [*by, "_bin0"]) & F.col("r._value").between(F.col("a._lo"), F.col("a._hi"))
    return held.alias("r").join(ranges.alias("a"), on)


def gap_ranges(rows: DataFrame, by: str, ordered_rows: int) -> tuple[DataFrame, DataFrame]:
    """Where two empirical distributions can be farthest apart, per group.

    ``rows(by, _value, _r)``; ``_r`` is 1 for the first sample and 0 for the second. The first
    result has per group the largest gap at the end of any bin (``_best``) and the sizes
    (``_rows_r``, ``_rows_b``); the second the ranges of at most ``ordered_rows`` rows in which the
    gap may be larger, with the rows of each sample before them (``_r0``, ``_b0``).

    Inside a range the first share lies between its values at both ends, and so does the second:
    no gap exceeds the larger difference of opposite ends.
    """
    sums = [
        F.sum("_r").alias("_rn"),
        F.sum(1 - F.col("_r")).alias("_bn"),
        F.min("_value").alias("_lo"),
        F.max("_value").alias("_hi"),
    ]
    coarse = persist_state(rows.groupBy(by, _value_bin(F.col("_value")).alias("_bin")).agg(*sums), "bins")
    keyed = W.partitionBy(by)
    bins = coarse.withColumns(
        {
            "_rows_r": F.sum("_rn").over(keyed),
            "_rows_b": F.sum("_bn").over(keyed),
            "_start_r": F.lit(0).cast("bigint"),
            "_start_b": F.lit(0).cast("bigint"),
            "_bin0": F.col("_bin"),
            "_of": F.lit(0.0),
        }
    )
    share = lambda a, b: F.abs(a / F.nullif(F.col("_rows_r"), F.lit(0)) - b / F.nullif(F.col("_rows_b"), F.lit(0)))
    first, last = (F.col("_r0"), F.col("_b0")), (F.col("_r0") + F.col("_rn"), F.col("_b0") + F.col("_bn"))
    columns = [by, "_bin0", "_lo", "_hi", "_rn", "_bn", "_r0", "_b0", "_rows_r", "_rows_b"]
    best, done = None, []
    inside, level = [], ["_of"]
    while True:
        upto = W.partitionBy(by, *inside).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = bins.withColumns(
            {
                "_r0": F.col("_start_r") + F.sum("_rn").over(upto) - F.col("_rn"),
                "_b0": F.col("_start_b") + F.sum("_bn").over(upto) - F.col("_bn"),
            }
        )
        placed = persist_state(placed.select(*columns), "gaps")
        ends = placed.groupBy(by).agg(
            F.max(F.coalesce(share(*last), F.lit(0.0))).alias("_best"),
            F.max("_rows_r").alias("_rows_r"),
            F.max("_rows_b").alias("_rows_b"),
        )
        if best is not None:
            ends = ends.unionByName(best).groupBy(by).agg(
                *[F.max(c).alias(c) for c in ("_best", "_rows_r", "_rows_b")]
            )
        best = persist_state(ends, "best")
        bound = F.greatest(share(last[0], first[1]), share(first[0], last[1]))
        done.append(placed)
        limits = best.select(F.col(by).alias("_k"), "_best")
        possible = [
            part.join(limits, F.col(by).eqNullSafe(F.col("_k"))).where((F.col("_lo") < F.col("_hi")) & (bound > F.col("_best")))
            for part in done
        ]
        small = F.col("_rn") + F.col("_bn") <= ordered_rows
        wide = possible[-1].where(~small).select(*columns)
        if wide.isEmpty():
            kept = [part.where(small).select(*columns) for part in possible]
            return best, functools.reduce(DataFrame.unionByName, kept)
        at = F.floor((F.col("r._value") - F.col("a._lo")) / (F.col("a._hi") - F.col("a._lo")) * SUB_BINS)
        cut = (
            in_ranges(rows, wide, [by])
            .groupBy(
                F.col(f"r.{by}").alias(by),
                "a._bin0",
                F.col("a._lo").alias("_of"),
                F.col("a._r0").alias("_start_r"),
                F.col("a._b0").alias("_start_b"),
                "a._rows_r",
                "a._rows_b",
                F.least(at, F.lit(SUB_BINS - 1)).alias("_bin"),
            )
            .agg(
                F.sum("r._r").alias("_rn"),
                F.sum(1 - F.col("r._r")).alias("_bn"),
                F.min("r._value").alias("_lo"),
                F.max("r._value").alias("_hi"),
            )
        )
        bins, inside = persist_state(cut, "bins"), ["_bin0", *level]


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: list[str] | None = None,
    leave_out: tuple[str, int] | None = None,
    stored: bool = False,
    ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per entry.

    ``leave_out`` = (fold column, k) gives the quantiles outside every fold as extra groups
    ``held_out`` = 0..k-1, and over all rows as -1. All of them are answered from one histogram
    per (group, fold) by adding bins; no row is repeated per fold.

    NULL and NaN don't count. The needed columns are written once (``stored``: ``df`` already is
    a stored table), counted per bin, and ranges that hold a wanted rank are cut until they
    have one value or at most ``ordered_rows`` rows, see ``bracket``. Only the values of
    those ranges are shuffled and ordered, so neither a narrow band nor a hot value or a hot
    group meets in one task.
    """
    by = list(by or [])
    base = [*by, leave_out[0]] if leave_out else by
    group = [*by, "held_out"] if leave_out else by
    number = F.col(value).cast("double") + F.lit(0.0)  # no negative zero
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*base, number.alias("_value"))
    rows = rows if stored else persist_state(rows, "values")
    found = bracket(rows, probabilities, by, leave_out, ordered_rows)
    several = found.where("_lo < _hi")
    ranges = several.select(*by, "_bin0", "_lo", "_hi").distinct()
    counted = (
        in_ranges(rows, ranges, by)
        .groupBy(*[F.col(f"r.{c}").alias(c) for c in base], "a._bin0", "a._lo", F.col("r._value").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    same = _same("c", "h", [*by, "_bin0", "_lo"])
    if leave_out:
        same = same & (F.col(f"c.{leave_out[0]}") != F.col("h.held_out"))
    upto = W.partitionBy(*group, "_bin0", "_lo").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = (
        counted.alias("c")
        .join(several.alias("h"), same)
        .select(*[F.col(f"h.{c}").alias(c) for c in [*group, "_bin0", "_lo", "_before", "_rows"]], "c._value", "c._c")
        .groupBy(*group, "_bin0", "_lo", "_before", "_rows", "_value")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(upto))
    )
    alone = found.where("_lo >= _hi").withColumns({"_value": F.col("_lo"), "_upto": F.col("_before") + F.col("_bn")})
    columns = [*group, "_rows", "_value", "_upto"]
    candidates = ordered.select(*columns).unionByName(alone.select(*columns))
    ranks = _ranks(probabilities)
    picked = candidates.groupBy(*group).agg(
        F.max("_rows").alias("_rows"),
        *[F.min(F.when(F.col("_upto") > lo, F.col("_value"))).alias(f"_lo_{n}") for n, (lo, _) in ranks.items()],
        *[F.min(F.when(F.col("_upto") > hi, F.col("_value"))).alias(f"_hi_{n}") for n, (_, hi) in ranks.items()],
    )
    position = {n: (F.col("_rows") - 1) * F.lit(float(p)) for n, p in probabilities.items()}
    return picked.select(
        *group,
        *[
            F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}"))
            .otherwise(
                F.col(f"_lo_{n}")
                + (position[n] - F.floor(position[n])) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
            )
            .alias(n)
            for n in probabilities
        ],
    )


def hash_rank_thresholds(
    hashed: DataFrame,
    hash_col: str,
    fractions: dict[str, float],
    by: list[str] | None = None,
    as_rows: bool = False,
) -> DataFrame:
    """The hash values that cut each group at exactly floor(n * fraction) rows.

    Returns one row per group with ``n_rows`` and, per fraction, ``<name>`` (take every row
    with a smaller or equal hash) and ``<name>_excess`` (rows at that hash beyond the wanted
    number; only repeated keys make it positive). A fraction of no rows gives -1. With
    ``as_rows`` the fractions are numbers of rows.
    """
    by = list(by or [])
    spread = hashed.withColumn("_bin", F.shiftrightunsigned(F.col(hash_col), HASH_BITS - 16))
    keyed = W.partitionBy(*by)
    upto = keyed.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    if as_rows:
        wanted = {n: F.lit(int(f)).cast("bigint") for n, f in fractions.items()}
    else:
        wanted = {n: F.floor(F.col("_rows") * F.lit(float(f))) for n, f in fractions.items()}
    bins = (
        spread.groupBy(*by, "_bin")
        .agg(F.count(F.lit(1)).alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(upto) - F.col("_bn"))
        .withColumn("_rows", F.sum("_bn").over(keyed))
    )
    holds = F.exists(
        F.array(*wanted.values()),
        lambda k: ((k > F.col("_before")) | ((k == 0) & (F.col("_before") == 0)))
        & (k <= F.col("_before") + F.col("_bn")),
    )
    inside = W.partitionBy(*by, "_bin").orderBy(hash_col)
    candidates = (
        spread.alias("s")
        .join(bins.where(holds).alias("b"), _same("s", "b", [*by, "_bin"]))
        .select(*[F.col(f"s.{c}").alias(c) for c in [*by, "_bin", hash_col]], "b._before", "b._rows")
        .groupBy(*by, "_bin", hash_col, "_before", "_rows")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_upto", F.col("_before") + F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
        )
    )
    return candidates.groupBy(*by).agg(
        F.max("_rows").alias("n_rows"),
        *[
            F.coalesce(F.min(F.when((k > 0) & (F.col("_upto") >= k), F.col(hash_col))), F.lit(-1)).alias(n)
            for n, k in wanted.items()
        ],
        *[
            F.coalesce(F.min(F.when((k > 0) & (F.col("_upto") >= k), F.col("_upto") - k)), F.lit(0)).alias(
                f"{n}_excess"
            )
            for n, k in wanted.items()
        ],
    )


def expand_counts(df: DataFrame, count_col: str, chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``count_col`` times, in two bounded steps so no array grows with the count."""
    chunked = df.withColumn(
        "_chunk",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count_col) - 1) / F.lit(chunk)))),
    )
    size = F.least(F.lit(chunk).cast("bigint"), F.col(count_col) - F.col("_chunk") * chunk)
    return (
        chunked.where(F.col(count_col) > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
        .drop("_chunk", "_copy", count_col)
    )


def number_up(df: DataFrame, count: Column, name: str, chunk: int = 100_000) -> DataFrame:
    """Rows numbered 0 .. count - 1 in ``name``, in two bounded steps; a count of 0 or less gives none."""
    counted = df.withColumn("_count", count.cast("bigint")).where(F.col("_count") > 0)
    zero, size = F.lit(0).cast("bigint"), F.lit(chunk).cast("bigint")
    chunked = counted.withColumn("_chunk", F.explode(F.sequence(zero, F.floor((F.col("_count") - 1) / size))))
    first = F.col("_chunk") * size
    return chunked.withColumn(
        name, F.explode(F.sequence(first, F.least(first + size, F.col("_count")) - 1))
    ).drop("_count", "_chunk")


def numbered(df: DataFrame, group: str, order: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of a column inside each group.

    Rows are range partitioned by (group, order) and sorted inside their range; where a range
    starts in its group follows from one small row per (range, group). A group of any size is
    spread over the ranges. ``df`` is read twice, for the limits of the ranges and for its rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first()]
    # the identifier counts up inside a partition; its upper bits are the partition
    ranged = persist_state(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_id", 33)),
        "ranges",
    )
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    return (
        ranged.alias("r")
        .join(starts.alias("s"), _same("r", "s", [group, "_range"]))
        .select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("r._id") + F.col("s._shift")).alias(name))
    )
