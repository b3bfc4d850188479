"""Profiling and quality analytics.

Counts over several dimensions share one shuffle, materials are counted after map-side
aggregation, and windows run on aggregated tables only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.constants import (
    DEFICIT_CATEGORIES,
    DEFICIT_SYNONYMS,
    EARTH_CIRCUMFERENCE_KM,
    ERROR_CLASSES,
    ERRONEOUS_AUDIT,
    EXPECTED_PARENT,
    FOOTWEAR_MATERIALS,
    FOOTWEAR_ONLY,
    GENDER_RECODE,
    NAME_ISSUES,
    NAMING_VARIANTS,
    PARENTS,
    QUESTIONABLE,
    RARE_ASSESSMENTS,
    RARITY_TIERS,
    TYPICALLY_FEMALE,
)
from weftline.functions.columns import (
    any_of,
    band_label,
    literal_map,
    rename_expr,
    share_pct,
    total,
    values_table,
)
from weftline.functions.ranking import exact_quantiles, number_up
from weftline.operators.clean import unfold
from weftline.operators.compose import names_any, parse_materials
from weftline.session import persist_state

DIMENSIONS = ["category", "parent_category", "gender", "manufacturer_country"]


def _dims(dims: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims]))


# --- counts -------------------------------------------------------------------------------


def overview(df: DataFrame, dims: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Row count and number of distinct values per dimension."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[distinct(F.col(d)).alias(f"n_{d}") for d in dims or DIMENSIONS]
    )


def value_counts(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """(dim, value, n, pct of all rows) for every dimension in one shuffle; NULL values are left out."""
    counts = df.select(_dims(dims or DIMENSIONS).alias("d")).groupBy("d.dim", "d.value").agg(F.count(F.lit(1)).alias("n"))
    counts = persist_state(counts, "counts")
    rows = counts.groupBy("dim").agg(F.sum("n").alias("_rows"))
    shared = counts.join(rows, "dim").withColumn("pct", share_pct(F.col("n"), F.col("_rows"))).drop("_rows")
    return shared.where(F.col("value").isNotNull())


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties go by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column)).limit(k)


def hierarchy_counts(df: DataFrame, parent: str = "parent_category", category: str = "category") -> DataFrame:
    counts = df.dropna("any", subset=[parent, category]).groupBy(parent, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col(parent), F.col("n").desc(), F.col(category))


def count_distribution(df: DataFrame, column: str = "category") -> DataFrame:
    """Spread of the per-value counts; aggregates one row per distinct value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.min("n").alias("min"),
        F.max("n").alias("max"),
        F.avg("n").alias("mean"),
        F.percentile("n", 0.5).alias("median"),
        F.stddev_samp("n").alias("std"),
    )


def before_after(before: DataFrame, after: DataFrame, column: str = "category") -> DataFrame:
    """Counts per value in two tables; a value missing on one side counts zero there."""
    b = before.groupBy(column).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(column).agg(F.count(F.lit(1)).alias("n_after"))
    both = b.join(a, column, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("change", F.col("n_after") - F.col("n_before"))


# --- numbers ------------------------------------------------------------------------------


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, std, quartiles and inter-quartile range per column, all exact."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(cells).alias("c")).select("c.metric", "c.value").where(F.col("value").isNotNull())
    moments = long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    quartiles = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["metric"])
    return moments.join(quartiles, "metric").withColumn("iqr", F.col("q3") - F.col("q1"))


def category_weight_stats(
    df: DataFrame, column: str = "category", value: str = "weight_kg", low: float = 0.1, high: float = 3.0
) -> DataFrame:
    """Weight statistics per category; a mean below ``low`` or above ``high`` is suspicious."""
    known = df.where(F.col(value).isNotNull() & F.col(column).isNotNull()).select(column, value)
    stats = known.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("std"),
    )
    medians = exact_quantiles(known, value, {"median": 0.5}, [column])
    return stats.join(medians, column).withColumn("suspicious", (F.col("mean") < low) | (F.col("mean") > high))


def band_counts(df: DataFrame, bands: dict[str, tuple[str, list[tuple]]]) -> DataFrame:
    """(kind, band, n, pct) for several band tables at once; ``kind -> (column, bands)``."""
    cells = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), band_label(F.col(column), table).alias("band"))
            for kind, (column, table) in bands.items()
        ]
    )
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.band").agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum("n").over(W.partitionBy("kind"))
    return counts.withColumn("pct", share_pct(F.col("n"), rows)).where(F.col("band").isNotNull())


def unit_error_test(
    df: DataFrame, column: str = "weight_kg", low: float = 0.01, high: float = 10.0, normal=(0.1, 5.0)
) -> DataFrame:
    """How many suspicious weights become normal when read in the other unit."""
    value = F.col(column)
    tests = {"low": (value < low, value * 1000.0), "high": (value > high, value / 1000.0)}
    counts = df.agg(
        *[F.count_if(test).alias(f"{side}_n") for side, (test, _) in tests.items()],
        *[F.count_if(test & v.between(*normal)).alias(f"{side}_fixed") for side, (test, v) in tests.items()],
    )
    rows = unfold(
        counts,
        "side",
        {s: {"n": F.col(f"{s}_n"), "n_corrected": F.col(f"{s}_fixed")} for s in tests},
    ).withColumn("pct", share_pct(F.col("n_corrected"), F.col("n")))
    verdict = F.when(F.col("pct") > 80, "strong").when(F.col("pct") > 50, "moderate").otherwise("unlikely")
    return rows.withColumns({"verdict": verdict, "is_issue": F.coalesce(F.col("pct") > 70, F.lit(False))})


_SIDES = {"smallest": 1, "largest": -1}
MAX_LISTED = 1_000  # longer lists are sorted without a limit


def _reached_by(df: DataFrame, id_col: str, columns: list[str], k: int) -> dict[tuple[str, str], float | None]:
    """Per (column, side) a value that at least k rows reach, None when no such value is found.

    Rows are dealt to 64 * k groups by a hash; k groups have a best value at least as good as the
    k-th of all best values, which is therefore reached k times.
    """
    wanted = [(c, side) for c in columns for side in _SIDES]
    if k > MAX_LISTED:
        return dict.fromkeys(wanted)
    best = (
        df.groupBy(F.pmod(F.xxhash64(id_col, *columns), F.lit(64 * k)).alias("_group"))
        .agg(*[F.min(F.col(c) * _SIDES[side]).alias(f"_{i}") for i, (c, side) in enumerate(wanted)])
        .collect()
    )
    limits = {}
    for i, cell in enumerate(wanted):
        found = sorted((r[f"_{i}"] for r in best if r[f"_{i}"] is not None), key=lambda v: (v != v, v))  # NaN is last
        limits[cell] = found[k - 1] if len(found) >= k > 0 else None
    return limits


def extremes(df: DataFrame, id_col: str, columns: list[str], k: int = 10) -> DataFrame:
    """The k smallest and largest values per column; ties go by id.

    A first scan finds a value per (column, side) that k rows reach at least, a second one
    reads the rows that reach one. Every task keeps the k best of these before anything is
    shuffled, so only the few candidates are sorted, and the short lists are merged.
    """
    limits = _reached_by(df, id_col, columns, k)
    cells, reached = [], []
    for (c, side), limit in limits.items():
        key = F.col(c) * _SIDES[side]
        reached.append(F.col(c).isNotNull() if limit is None else key <= F.lit(limit))
        cell = F.struct(F.lit(c).alias("column"), F.lit(side).alias("side"), F.col(c).alias("value"), key.alias("_key"))
        cells.append(F.when(reached[-1], cell))
    candidates = df.where(any_of(reached)).select(id_col, F.explode(F.array(*cells)).alias("c"))
    long = candidates.where(F.col("c.value").isNotNull())
    order = W.partitionBy("c.column", "c.side").orderBy("c._key", id_col)
    best = long.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    ratio = (F.col("c.value") / EARTH_CIRCUMFERENCE_KM).alias("earth_ratio")
    return best.select("c.column", "c.side", id_col, "c.value", ratio)


def outlier_breakdown(
    df: DataFrame,
    dims: list[str] | None = None,
    column: str = "total_distance_km",
    limit: float = 40000.0,
    k: int = 10,
) -> DataFrame:
    """Outliers per value of each dimension with their mean; the k most frequent per dimension."""
    counts = (
        df.where(F.col(column) >= limit)
        .select(column, _dims(dims or ["category", "manufacturer_country"]).alias("d"))
        .where(F.col("d.value").isNotNull())
        .groupBy("d.dim", "d.value")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"))
    )
    return top_n_per_group(counts, "dim", "n", "value", k)


def numeric_anomalies(df: DataFrame, weight: str = "weight_kg", distance: str = "total_distance_km") -> DataFrame:
    """Extreme, non-positive and missing numbers, from one aggregation."""
    tests = {
        ("weight", "extreme_low"): F.col(weight) < 0.01,
        ("weight", "extreme_high"): F.col(weight) > 50,
        ("weight", "zero_or_negative"): F.col(weight) <= 0,
        ("weight", "missing"): F.col(weight).isNull(),
        ("distance", "extreme_low"): F.col(distance) < 1,
        ("distance", "extreme_high"): F.col(distance) > 40000,
        ("distance", "zero_or_negative"): F.col(distance) <= 0,
        ("distance", "missing"): F.col(distance).isNull(),
    }
    counts = df.agg(*[F.count_if(t).alias(f"{f}_{k}") for (f, k), t in tests.items()])
    cells = [
        F.struct(F.lit(f).alias("field"), F.lit(k).alias("anomaly"), F.col(f"{f}_{k}").alias("n")) for f, k in tests
    ]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def shape_stats(df: DataFrame, column: str = "weight_kg", low: float = 0.001, high: float = 10.0) -> DataFrame:
    """Log spread, skewness, excess kurtosis and the Jarque-Bera statistic on an open range."""
    value = F.col(column)
    stats = (
        df.where((value > low) & (value < high))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.log10(value)).alias("log10_mean"),
            F.stddev_samp(F.log10(value)).alias("log10_std"),
            F.skewness(value).alias("skewness"),
            F.kurtosis(value).alias("kurtosis"),
        )
        .withColumn(
            "jarque_bera",
            F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0),
        )
    )
    # fixed value: chi-square quantile with two degrees of freedom at 0.95
    return stats.withColumn("is_normal", F.col("jarque_bera") < 5.991)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the minimum and the maximum; the last bin includes the maximum."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin bigint, low double, high double, n bigint")
    width = (high - low) / bins if high > low else 1.0
    position = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("bigint")
    counts = df.where(F.col(column).isNotNull()).groupBy(position.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        "n",
    )


def rank_trend(df: DataFrame, column: str = "manufacturer_country", k: int = 50) -> DataFrame:
    """Straight line through the counts of the k most frequent values by rank."""
    ranked = top_k(df, column, k).withColumn(
        "rank", F.row_number().over(W.orderBy(F.col("n").desc(), F.col(column))) - 1
    )
    return ranked.agg(
        F.count(F.lit(1)).alias("n_values"),
        F.regr_slope(F.col("n").cast("double"), F.col("rank").cast("double")).alias("slope"),
        F.regr_intercept(F.col("n").cast("double"), F.col("rank").cast("double")).alias("intercept"),
    )


# --- materials ----------------------------------------------------------------------------


def named_materials(df: DataFrame, keep: list[str], materials: str = "materials") -> DataFrame:
    """One row per product and distinct material name."""
    names = F.array_distinct(F.map_keys(parse_materials(F.col(materials))))
    return df.select(*keep, F.explode(names).alias("material"))


def material_frequency(df: DataFrame, materials: str = "materials") -> DataFrame:
    """Products naming each material, with their share of the products that parse.

    An array of names counts like an object. Parse totals travel as marked entries of the
    same aggregation, so the table is read once.
    """
    text = F.col(materials)
    names = F.coalesce(F.map_keys(parse_materials(text)), F.from_json(text, "array<string>"))
    df = df.select(names.alias("_names"))
    names = F.col("_names")
    marked = F.when(
        names.isNotNull(),
        F.concat(
            F.array(F.struct(F.lit("parsed").alias("kind"), F.lit("").alias("material"))),
            F.transform(
                F.array_distinct(names), lambda m: F.struct(F.lit("name").alias("kind"), m.alias("material"))
            ),
        ),
    ).otherwise(F.array(F.struct(F.lit("failed").alias("kind"), F.lit("").alias("material"))))
    counts = df.select(F.explode(marked).alias("e")).groupBy("e.kind", "e.material").agg(F.count(F.lit(1)).alias("n"))
    counts = persist_state(counts, "counts")
    totals = {r["kind"]: r["n"] for r in counts.where(F.col("kind") != "name").collect()}  # two rows at most
    parsed, failed = (F.lit(totals.get(kind, 0)).cast("bigint") for kind in ("parsed", "failed"))
    out = counts.where(F.col("kind") == "name").withColumns({"n_parsed": parsed, "n_failed": failed})
    return out.withColumn("pct", share_pct(F.col("n"), F.col("n_parsed"))).select(
        "material", "n", "pct", "n_parsed", "n_failed"
    )


def material_by(df: DataFrame, dims: list[str], materials: str = "materials") -> DataFrame:
    """Counts per material and value of each dimension, with the share inside that value."""
    long = named_materials(df, dims, materials)
    counts = (
        long.select("material", _dims(dims).alias("d"))
        .where(F.col("d.value").isNotNull())
        .groupBy("d.dim", "d.value", "material")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inside = F.sum("n").over(W.partitionBy("dim", "value"))
    return counts.withColumn("pct", share_pct(F.col("n"), inside))


def top_n_per_group(counts: DataFrame, group: str, count: str, name: str, n: int) -> DataFrame:
    """The n largest counts per group of an aggregated table; ties go by name."""
    order = W.partitionBy(group).orderBy(F.col(count).desc(), F.col(name))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def material_matrix(df: DataFrame, row: str = "parent_category", k: int = 12) -> DataFrame:
    """Rows of ``row`` by the k most frequent materials, zero-filled, with the row total."""
    pairs = (
        named_materials(df, [row])
        .where(F.col(row).isNotNull())
        .groupBy(row, "material")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = persist_state(pairs, "pairs")
    totals = pairs.groupBy("material").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "material")
    columns = [x["material"] for x in totals.limit(k).collect()]
    wide = pairs.groupBy(row).pivot("material", columns).agg(F.sum("n")).na.fill(0, columns)
    return wide.withColumn("row_total", total([F.col(f"`{c}`") for c in columns])).orderBy(
        F.col("row_total").desc(), row
    )


def material_heatmap(
    df: DataFrame, row: str = "category", rows: int = 15, columns: int = 20, materials: str = "materials"
) -> DataFrame:
    """Top rows by top materials as (row, material, n, share of the row)."""
    names = F.coalesce(F.array_distinct(F.map_keys(parse_materials(F.col(materials)))), F.array().cast("array<string>"))
    # a NULL name counts the row itself, so one pass gives both tops and the pairs
    marked = F.explode(F.concat(F.array(F.lit(None).cast("string")), names)).alias("material")
    counts = persist_state(
        df.where(F.col(row).isNotNull()).select(row, marked).groupBy(row, "material").agg(F.count(F.lit(1)).alias("n")),
        "pairs",
    )
    best_rows = (
        counts.where(F.col("material").isNull()).orderBy(F.col("n").desc(), F.col(row)).limit(rows).select(row)
    )
    pairs = counts.where(F.col("material").isNotNull())
    best_materials = (
        pairs.groupBy("material")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "material")
        .limit(columns)
        .select("material")
    )
    kept = pairs.join(best_rows, row, "left_semi").join(best_materials, "material", "left_semi")
    return kept.withColumn("pct", share_pct(F.col("n"), F.sum("n").over(W.partitionBy(row))))


def gender_split(df: DataFrame, gender: str = "gender", materials: str = "materials") -> DataFrame:
    """Male and female products per material."""
    counts = (
        named_materials(df, [gender], materials)
        .groupBy("material")
        .agg(
            F.count_if(F.col(gender) == "Male").alias("n_male"),
            F.count_if(F.col(gender) == "Female").alias("n_female"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return counts.withColumns(
        {
            "pct_male": share_pct(F.col("n_male"), F.col("n")),
            "pct_female": share_pct(F.col("n_female"), F.col("n")),
        }
    )


def rarity_tier(counts: DataFrame, count: str = "n", tiers: list[tuple[str, int]] | None = None) -> DataFrame:
    tier = F.lit("very_common")
    for name, bound in reversed(RARITY_TIERS if tiers is None else tiers):
        tier = F.when(F.col(count) < bound, F.lit(name)).otherwise(tier)
    return counts.withColumn("tier", tier)


def low_usage_issues(counts: DataFrame, tiers: list[tuple[str, int]] | None = None) -> DataFrame:
    """Likely issue and correct form of very rare names, assessment of rare ones."""
    name = F.col("material")
    issue, form = F.lit("Unknown"), F.lit("Needs review")
    for text, kind, correct in reversed(NAME_ISSUES):
        test = name == text[1:] if text.startswith("=") else name.contains(text)
        issue, form = F.when(test, kind).otherwise(issue), F.when(test, correct).otherwise(form)
    assessment = F.lit("Needs review")
    for text, verdict in reversed(RARE_ASSESSMENTS):
        assessment = F.when(name.contains(text), verdict).otherwise(assessment)
    tiered = rarity_tier(counts, "n", tiers).where(F.col("tier").isin("very_rare", "rare"))
    very_rare = F.col("tier") == "very_rare"
    return tiered.withColumns(
        {
            "issue_type": F.when(very_rare, issue),
            "correct_form": F.when(very_rare, form),
            "assessment": F.when(~very_rare, assessment),
        }
    )


def material_examples(
    df: DataFrame, names: list[str], id_col: str, keep: list[str], k: int = 3, materials: str = "materials"
) -> DataFrame:
    """k example products per named material; Spark keeps k rows per task before the shuffle."""
    long = named_materials(df, [id_col, *keep], materials).where(F.col("material").isin(names))
    order = W.partitionBy("material").orderBy(id_col)
    return long.withColumn("example", F.row_number().over(order)).where(F.col("example") <= k)


def material_deficit(df: DataFrame, target: int = 35_000, materials: str = "materials") -> DataFrame:
    """Materials below the target and the number of products needed."""
    counts = named_materials(df, [], materials).groupBy(F.col("material").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") < target).withColumn("needed", F.lit(target) - F.col("n"))


def category_deficit(
    df: DataFrame,
    target: int = 25_000,
    categories: list[str] | None = None,
    synonyms: dict[str, str] | None = None,
    category: str = "category",
) -> DataFrame:
    """Target categories (synonyms merged, absent ones counted as zero) and the number needed."""
    wanted = DEFICIT_CATEGORIES if categories is None else categories
    merged = rename_expr(F.col(category), DEFICIT_SYNONYMS if synonyms is None else synonyms)
    counts = df.agg(*[F.count_if(merged == c).alias(f"c{i}") for i, c in enumerate(wanted)])
    rows = unfold(counts, "name", {c: {"n": F.col(f"c{i}")} for i, c in enumerate(wanted)})
    return rows.withColumn("needed", F.greatest(F.lit(target) - F.col("n"), F.lit(0)))


def deficit_batches(deficit: DataFrame, batch: int = 1000) -> DataFrame:
    """One row per batch still to produce; the last one may be smaller."""
    return (
        number_up(deficit, F.ceil(F.col("needed") / F.lit(batch)), "batch_no")
        .withColumn("batch_size", F.least(F.lit(batch).cast("bigint"), F.col("needed") - F.col("batch_no") * batch))
    )


# --- consistency --------------------------------------------------------------------------


def category_parent_mismatch(
    df: DataFrame,
    expected: dict[str, str] | None = None,
    category: str = "category",
    parent: str = "parent_category",
) -> DataFrame:
    """(category, parent) pairs that contradict the expected map or have no entry in it."""
    wanted = F.element_at(literal_map(EXPECTED_PARENT if expected is None else expected), F.col(category))
    pairs = (
        df.where(F.col(category).isNotNull() & F.col(parent).isNotNull())
        .groupBy(category, parent)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("expected_parent", wanted)
    )
    kind = F.when(F.col("expected_parent").isNull(), "orphan").when(
        F.col("expected_parent") != F.col(parent), "mismatch"
    )
    return pairs.withColumn("issue", kind).where(F.col("issue").isNotNull())


def gender_category_issues(
    df: DataFrame, categories: list[str] | None = None, category: str = "category", gender: str = "gender"
) -> DataFrame:
    """Male products in typically female categories."""
    counts = (
        df.where(F.col(category).isin(TYPICALLY_FEMALE if categories is None else categories))
        .groupBy(category)
        .agg(F.count_if(F.col(gender) == "Male").alias("n_male"), F.count(F.lit(1)).alias("n"))
    )
    return counts.where(F.col("n_male") > 0).withColumn("pct", share_pct(F.col("n_male"), F.col("n")))


def material_category_issue(comp: Column, parent: str = "parent_category") -> Column:
    """Issue of a product whose materials do not fit its parent category, else NULL."""
    is_footwear = F.coalesce(F.col(parent) == "Footwear", F.lit(False))
    return (
        F.when(~is_footwear & names_any(comp, FOOTWEAR_ONLY), "footwear_material_in_clothing")
        .when(
            is_footwear & comp.isNotNull() & ~names_any(comp, FOOTWEAR_MATERIALS),
            "no_footwear_material_in_footwear",
        )
    )


def material_category_issues(df: DataFrame, category: str = "category", parent: str = "parent_category") -> DataFrame:
    """Products per kind of issue, parent and category."""
    parsed = df.select(category, parent, parse_materials(F.col("materials")).alias("_comp"))
    flagged = parsed.select(category, parent, material_category_issue(F.col("_comp"), parent).alias("issue"))
    return flagged.where(F.col("issue").isNotNull()).groupBy("issue", parent, category).agg(F.count(F.lit(1)).alias("n"))


def material_combinations(
    df: DataFrame, k: int = 10, category: str = "category", materials: str = "materials"
) -> DataFrame:
    """The k most frequent sets of material names, with an example category."""
    combo = F.array_join(F.array_sort(F.map_keys(parse_materials(F.col(materials)))), " + ")
    counts = (
        df.select(category, combo.alias("combination"))
        .where(F.col("combination").isNotNull())
        .groupBy("combination")
        .agg(F.count(F.lit(1)).alias("n"), F.min(category).alias("example_category"))
    )
    return counts.orderBy(F.col("n").desc(), "combination").limit(k)


def naming_variants(
    df: DataFrame, variants: dict[str, list[str]] | None = None, category: str = "category"
) -> DataFrame:
    """Counts of overlapping category names per variant group."""
    groups = NAMING_VARIANTS if variants is None else variants
    by_name = values_table(
        df.sparkSession, [(g, n) for g, names in groups.items() for n in names], ["variant_group", category]
    )
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(by_name, category)


def material_error_classes(
    df: DataFrame, classes: dict[str, list[str]] | None = None, materials: str = "materials"
) -> DataFrame:
    """Occurrences of wrong material names per class."""
    by_name = {n: c for c, names in (ERROR_CLASSES if classes is None else classes).items() for n in names}
    kind = F.element_at(literal_map(by_name), F.col("material"))
    return (
        named_materials(df, [], materials)
        .select(kind.alias("error_class"))
        .where(F.col("error_class").isNotNull())
        .groupBy("error_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def erroneous_products(
    df: DataFrame,
    erroneous: list[str] | None = None,
    questionable: list[str] | None = None,
    materials: str = "materials",
) -> DataFrame:
    """Products naming erroneous or questionable materials, their union and a recommendation."""
    comp = F.col("_comp")
    flags = df.select(parse_materials(F.col(materials)).alias("_comp")).select(
        names_any(comp, ERRONEOUS_AUDIT if erroneous is None else erroneous).alias("bad"),
        names_any(comp, QUESTIONABLE if questionable is None else questionable).alias("odd"),
    )
    counts = flags.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("bad").alias("n_erroneous"),
        F.count_if("odd").alias("n_questionable"),
        F.count_if(F.col("bad") | F.col("odd")).alias("n_combined"),
    )
    share = F.col("n_erroneous") / F.col("n_rows")
    return counts.withColumn(
        "recommendation", F.when(share < 0.001, "remove").when(share < 0.01, "review").otherwise("investigate")
    )


def issue_counts(df: DataFrame) -> DataFrame:
    """(issue, n) over all checks, from two passes.

    One pass counts (category, parent, gender) combinations, which carry every naming and
    hierarchy check; the other aggregates row-level flags.
    """
    combos = df.groupBy("category", "parent_category", "gender").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.element_at(literal_map(EXPECTED_PARENT), F.col("category"))
    group_of = F.element_at(
        literal_map({n: g for g, names in NAMING_VARIANTS.items() for n in names}), F.col("category")
    )
    pair = F.struct("category", "parent_category")
    hierarchy = combos.agg(
        F.count_distinct(F.when(wanted != F.col("parent_category"), pair)).alias("parent_mismatch"),
        F.count_distinct(F.when(wanted.isNull(), F.col("category"))).alias("orphan_category"),
        F.count_distinct(
            F.when(F.col("category").isin(TYPICALLY_FEMALE) & (F.col("gender") == "Male"), F.col("category"))
        ).alias("gender_category"),
        F.count_distinct(group_of).alias("naming"),
    )
    parsed = df.select(
        "weight_kg", "total_distance_km", "parent_category", parse_materials(F.col("materials")).alias("_comp")
    )
    comp = F.col("_comp")
    bad_names = [n for names in ERROR_CLASSES.values() for n in names]
    weight, distance = F.col("weight_kg"), F.col("total_distance_km")
    rows = parsed.select(
        "weight_kg",
        "total_distance_km",
        material_category_issue(comp).alias("material_issue"),
        F.array_size(F.filter(F.map_keys(comp), lambda m: m.isin(bad_names))).cast("bigint").alias("bad_names"),
    )
    flags = rows.agg(
        F.count_if(F.col("material_issue").isNotNull()).alias("material_category"),
        (F.count_if(weight < 0.01) + F.count_if(weight > 50) + F.count_if(weight <= 0) + F.count_if(weight.isNull()))
        .alias("weight_anomaly"),
        (
            F.count_if(distance < 1)
            + F.count_if(distance > 40000)
            + F.count_if(distance <= 0)
            + F.count_if(distance.isNull())
        ).alias("distance_anomaly"),
        F.coalesce(F.sum("bad_names"), F.lit(0)).alias("material_error"),
    )

    def long(frame: DataFrame) -> DataFrame:
        return unfold(frame, "issue", {c: {"n": F.col(c)} for c in frame.columns})

    return long(hierarchy).unionByName(long(flags))


def issue_total(df: DataFrame) -> DataFrame:
    return issue_counts(df).agg(F.sum("n").alias("total_issues"))


def pca_spread(
    df: DataFrame,
    numeric: list[str] | None = None,
    gender: str = "gender",
    parent: str = "parent_category",
    parents: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Two principal components over all complete rows.

    Numbers are standardised (population deviation), gender is coded 0 (Male) and 1 (Female)
    after recoding, the parent category is one-hot; all columns are centred, codes are not
    scaled. Rows with another gender or parent are left out.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    numeric = numeric or ["weight_kg", "total_distance_km"]
    parents = parents or PARENTS
    code = F.element_at(literal_map({g: float(i) for i, g in enumerate(("Male", "Female"))}), rename_expr(F.col(gender), GENDER_RECODE))
    known = df.withColumn("_gender", code).where(F.col("_gender").isNotNull() & F.col(parent).isin(parents))
    known = known.dropna("any", subset=numeric)
    hot = {f"_p{i}": (F.col(parent) == p).cast("double") for i, p in enumerate(parents)}
    known = known.withColumns({**hot, **{f"_n{i}": F.col(c).cast("double") for i, c in enumerate(numeric)}})
    names = [*[f"_n{i}" for i in range(len(numeric))], "_gender", *hot]
    row = known.agg(
        *[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(f"_n{i}").alias(f"s_n{i}") for i in range(len(numeric))]
    ).first()
    if row[f"m{names[0]}"] is None:
        return known.select(*(keep or []), F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2"))
    deviation = {f"_n{i}": row[f"s_n{i}"] or 1.0 for i in range(len(numeric))}
    centred = known.withColumns(
        {c: (F.col(c) - F.lit(row[f"m{c}"])) / F.lit(deviation.get(c, 1.0)) for c in names}
    )
    vectors = VectorAssembler(inputCols=names, outputCol="_vector").transform(centred)
    fitted = PCA(k=2, inputCol="_vector", outputCol="_pca").fit(vectors)
    axes = fitted.pc.toArray().T
    # an axis has no direction of its own: its largest loading (the first of equals) is positive
    signs = [1.0 if axis[max(range(len(axis)), key=lambda i: round(abs(axis[i]), 9))] > 0 else -1.0 for axis in axes]
    parts = vector_to_array(F.col("_pca"))
    return fitted.transform(vectors).select(
        *(keep or []), *[(parts[i] * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(2)]
    )
