"""Validation and repair of product tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.constants import (
    CATEGORY_RENAMES,
    CATEGORY_STANDARD,
    DISTANCE_RANGE,
    ERRONEOUS_FINAL,
    EXPECTED_PARENT,
    GENDER_RECODE,
    GENDERS,
    IMPOSSIBLE_MATERIALS,
    MATERIAL_RENAMES_FULL,
    MATERIALS,
    MAX_DISTANCE_KM,
    PARENTS,
    UNIT_HIGH_KG,
    UNIT_LOW_KG,
    WEIGHT_RANGE,
)
from weftline.functions.columns import any_of, rename_expr, share_pct
from weftline.operators.compose import (
    TEXT_MAP,
    composition_text,
    may_name,
    names_any,
    parse_materials,
    parse_texts,
    rename_keys,
    share_sum,
    text_names_any,
)
from weftline.session import persist_state


def unfold(df: DataFrame, key: str, values: dict[str, dict[str, Column]]) -> DataFrame:
    """Turn a one-row frame into rows: ``{label: {column: expression}}``."""
    cells = [
        F.struct(F.lit(label).alias(key), *[e.alias(name) for name, e in cols.items()])
        for label, cols in values.items()
    ]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


# --- completeness -------------------------------------------------------------------------


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and percentage per column, plus incomplete rows, from one aggregation."""
    columns = columns or df.columns
    incomplete = any_of([F.col(c).isNull() for c in columns])
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(incomplete).alias("_incomplete"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns],
    )
    rows = F.col("_rows")
    return unfold(
        counts,
        "column",
        {c: {"n_null": F.col(f"_null_{c}"), "pct": share_pct(F.col(f"_null_{c}"), rows)} for c in columns}
        | {"*": {"n_null": F.col("_incomplete"), "pct": share_pct(F.col("_incomplete"), rows)}},
    )


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=columns)


def drop_header_rows(df: DataFrame, columns: tuple[str, ...] = ("gender", "product_name")) -> DataFrame:
    """Remove header lines repeated inside the data; rows with NULL in these columns are kept."""
    return df.where(~any_of([F.col(c).eqNullSafe(F.lit(c)) for c in columns]))


# --- recoding -----------------------------------------------------------------------------


def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.withColumn(column, rename_expr(F.col(column), mapping))


def recode_gender(df: DataFrame, column: str = "gender", mapping: dict[str, str] | None = None) -> DataFrame:
    return recode(df, column, GENDER_RECODE if mapping is None else mapping)


def outside_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Values that are not in the domain, with their counts."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(domain))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def recode_category(df: DataFrame, column: str = "category", mapping: dict[str, str] | None = None) -> DataFrame:
    return recode(df, column, CATEGORY_RENAMES if mapping is None else mapping)


def standardise_category(
    df: DataFrame, column: str = "category", mapping: dict[str, str] | None = None
) -> DataFrame:
    return recode(df, column, CATEGORY_STANDARD if mapping is None else mapping)


def fix_orphan_category(
    df: DataFrame,
    category: str = "category",
    parent: str = "parent_category",
    name: str | None = "product_name",
) -> DataFrame:
    """Give the bare category 'Dresses' a real one and repair the parent 'Maxi'.

    With a name column the category follows the product name; without, it becomes 'Gowns'.
    """
    cat, par = F.col(category), F.col(parent)
    if name is None:
        replacement = F.lit("Gowns")
    else:
        text = F.col(name)
        replacement = (
            F.when(text.contains("Maxi"), "Maxi Dresses")
            .when(text.contains("Midi"), "Midi Dresses")
            .when(text.contains("Mini"), "Mini Dresses")
            .when(text.contains("Gown"), "Gowns")
            .otherwise("Maxi Dresses")
        )
    fixed = F.when(cat == "Dresses", replacement).when((par == "Maxi") & (cat == "Maxi"), "Maxi Dresses")
    return df.withColumns(
        {
            category: fixed.otherwise(cat),
            parent: F.when(par == "Maxi", "Dresses").otherwise(par),
        }
    )


def composition_of(materials: str, composition: str | None) -> Column:
    """The parsed composition: an existing column when named, else parsed from the text."""
    return parse_materials(F.col(materials)) if composition is None else F.col(composition)


# --- hierarchy and materials filters -------------------------------------------------------


def drop_hierarchy_anomalies(
    df: DataFrame,
    parents: list[str] | None = None,
    category: str = "category",
    parent: str = "parent_category",
) -> DataFrame:
    """Drop rows with an unknown parent or a category that only repeats a parent name."""
    valid = PARENTS if parents is None else parents
    return df.where(F.coalesce(F.col(parent).isin(valid), F.lit(False))).where(
        ~F.coalesce(F.col(category).isin(valid), F.lit(False))
    )


def drop_category_parent_mismatch(
    df: DataFrame,
    pairs: tuple[tuple[str, str], ...] = (("Maxi", "Maxi"),),
    category: str = "category",
    parent: str = "parent_category",
) -> DataFrame:
    """Drop rows with one of the given (category, parent) pairs."""
    bad = any_of([F.col(category).eqNullSafe(c) & F.col(parent).eqNullSafe(p) for c, p in pairs])
    return df.where(~bad)


def drop_erroneous_materials(
    df: DataFrame,
    names: list[str] | None = None,
    materials: str = "materials",
    composition: str | None = None,
) -> DataFrame:
    """Drop products that name a bad material; unparsable compositions stay."""
    bad = ERRONEOUS_FINAL if names is None else names
    if composition is None:
        return df.where(~text_names_any(F.col(materials), bad))
    return df.where(~names_any(F.col(composition), bad))


def drop_impossible_materials(
    df: DataFrame,
    names: list[str] | None = None,
    materials: str = "materials",
    composition: str | None = None,
) -> DataFrame:
    bad = IMPOSSIBLE_MATERIALS if names is None else names
    return drop_erroneous_materials(df, bad, materials, composition)


def rename_materials(
    df: DataFrame,
    mapping: dict[str, str] | None = None,
    materials: str = "materials",
    composition: str | None = None,
) -> DataFrame:
    """Rename materials inside the JSON text; shares are not converted (1 stays 1).

    Text that does not parse, or names nothing to rename, is left as it is.
    """
    names = MATERIAL_RENAMES_FULL if mapping is None else mapping
    text, comp = F.col(materials), composition_of(materials, composition)
    touched = may_name(text, list(names)) & names_any(comp, list(names))
    renamed = composition_text(rename_keys(parse_texts(text), names, kind=TEXT_MAP))
    return df.withColumn(materials, F.when(touched, renamed).otherwise(text))


# --- numbers ------------------------------------------------------------------------------


def coerce_numeric(df: DataFrame, columns: list[str], drop: bool = True) -> DataFrame:
    """Text to double with NULL for bad text and NaN; rows lacking a value are dropped."""
    number = {c: F.col(c).try_cast("double") for c in columns}
    out = df.withColumns({c: F.when(~F.isnan(n), n) for c, n in number.items()})
    return out.dropna("any", subset=columns) if drop else out


def range_filter(df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    bounds = bounds or {"weight_kg": WEIGHT_RANGE, "total_distance_km": DISTANCE_RANGE}
    return functools.reduce(lambda d, b: d.where(F.col(b[0]).between(*b[1])), bounds.items(), df)


def range_report(df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows below and above each range, and missing values, in one aggregation."""
    bounds = bounds or {"weight_kg": WEIGHT_RANGE, "total_distance_km": DISTANCE_RANGE}
    counts = df.agg(
        *[
            F.count_if(test).alias(f"{c}_{side}")
            for c, (low, high) in bounds.items()
            for side, test in (
                ("low", F.col(c) < low),
                ("high", F.col(c) > high),
                ("missing", F.col(c).isNull()),
            )
        ]
    )
    return unfold(
        counts,
        "column",
        {
            c: {f"n_{side}": F.col(f"{c}_{side}") for side in ("low", "high", "missing")}
            for c in bounds
        },
    )


def fix_weight_units(
    df: DataFrame, column: str = "weight_kg", low: float = UNIT_LOW_KG, high: float = UNIT_HIGH_KG
) -> DataFrame:
    """Rescale weights in the wrong unit: low values first, then high ones on the new value."""
    raised = F.when(F.col(column) < low, F.col(column) * 1000.0).otherwise(F.col(column))
    return df.withColumn(column, F.when(raised > high, raised / 1000.0).otherwise(raised))


def drop_distance_outliers(
    df: DataFrame, column: str = "total_distance_km", limit: float = MAX_DISTANCE_KM
) -> DataFrame:
    return df.where(F.col(column) <= limit)


# --- combining ----------------------------------------------------------------------------


def union_extra(base: DataFrame, extra: DataFrame, numeric: list[str]) -> DataFrame:
    """Append extra products, then coerce the numeric columns and drop rows lacking them."""
    return coerce_numeric(base.unionByName(extra), numeric)


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """128 bits of the values; rows that ``dropDuplicates`` takes as equal have equal digests."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    # zero has one sign; NULL is told apart from its neighbours by the second hash only
    values = [F.col(c) + F.lit(0).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    known = [F.col(c).isNull() for c in columns]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *reversed(values), *known).alias("b"))


MAX_REPEATED = 500_000  # digests of 16 bytes: about the default limit of a broadcast


def deduplicate_exact(df: DataFrame, columns: list[str] | None = None, digest: Column | None = None) -> DataFrame:
    """One row of every group of rows equal in ``columns`` (all of them by default).

    Two phases: 128-bit digests are counted, and only rows whose digest occurs again are
    compared whole. The others pass without being shuffled as long as the table of repeated
    digests is small enough to be broadcast by its measured size. With more repeated digests both
    kinds of rows would be shuffled to meet them; then all rows are compared whole at once.
    """
    columns = columns or df.columns
    marked = df.withColumn("_digest", row_digest(df, columns) if digest is None else digest)
    repeated = persist_state(
        marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_digest"), "digests"
    )
    if repeated.count() > MAX_REPEATED:
        return df.dropDuplicates(columns)
    once = marked.join(repeated, "_digest", "left_anti").select(*df.columns)
    again = marked.join(repeated, "_digest", "left_semi").select(*df.columns).dropDuplicates(columns)
    return once.unionByName(again)


# --- rule tables --------------------------------------------------------------------------


def in_domain(df: DataFrame, column: str, domain: DataFrame, flag: str) -> DataFrame:
    """Flag membership in a domain table of any size by a left join; NULL is in no domain."""
    name = domain.columns[0]
    side = domain.select(F.col(name).alias("_domain")).where(F.col("_domain").isNotNull()).distinct()
    return (
        df.join(side, F.col(column) == F.col("_domain"), "left")
        .withColumn(flag, F.col("_domain").isNotNull())
        .drop("_domain")
    )


def flag_rules(
    df: DataFrame,
    countries: DataFrame,
    genders: list[str] | None = None,
    categories: list[str] | None = None,
    weight_range: tuple[float, float] = (0.05, 5.0),
    distance_range: tuple[float, float] = (100.0, 25000.0),
    tolerance: float = 0.01,
    materials: str = "materials",
) -> DataFrame:
    """One boolean column per documented rule; true means the rule holds."""
    no = F.lit(False)
    comp = parse_materials(F.col(materials))
    flagged = df.withColumns(
        {
            "ok_gender": F.coalesce(F.col("gender").isin(genders or GENDERS), no),
            "ok_category": F.coalesce(F.col("category").isin(categories or list(EXPECTED_PARENT)), no),
            "ok_materials": F.coalesce(F.abs(share_sum(comp) - 1.0) <= tolerance, no),
            "ok_weight": F.coalesce(F.col("weight_kg").between(*weight_range), no),
            "ok_distance": F.coalesce(F.col("total_distance_km").between(*distance_range), no),
        }
    )
    return in_domain(flagged, "manufacturer_country", countries, "ok_country")


def rule_rates(flagged: DataFrame, prefix: str = "ok_") -> DataFrame:
    """Passing and failing rows per rule, from one aggregation."""
    rules = [c for c in flagged.columns if c.startswith(prefix)]
    counts = flagged.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c)).alias(c) for c in rules]
    )
    return unfold(
        counts,
        "rule",
        {
            c.removeprefix(prefix): {
                "n_pass": F.col(c),
                "n_fail": F.col("_rows") - F.col(c),
                "pct_fail": share_pct(F.col("_rows") - F.col(c), F.col("_rows")),
            }
            for c in rules
        },
    )


def validate_generated(
    df: DataFrame,
    vocabulary: list[str] | None = None,
    weight_range: tuple[float, float] = (0.05, 3.0),
    distance_range: tuple[float, float] = (100.0, 40000.0),
    fixable: tuple[str, ...] = ("polyster_virgin", "poliamide_6"),
    materials: str = "materials",
) -> DataFrame:
    """Keep rows with known materials and numbers that look measured rather than invented.

    A fixable misspelling counts as known; the row keeps the name it has.
    """
    known = (MATERIALS if vocabulary is None else vocabulary) + list(fixable)
    keys = F.map_keys(parse_materials(F.col(materials)))
    weight, distance = F.col("weight_kg"), F.col("total_distance_km")
    return (
        df.where(weight.between(*weight_range) & distance.between(*distance_range))
        .where((weight * 10 != F.floor(weight * 10)) & (distance % 100 != 0))
        .where(F.forall(keys, lambda k: k.isin(known)))
    )


# --- audit --------------------------------------------------------------------------------


def tag_first_failure(df: DataFrame, steps: list[tuple[str, Column]], out: str = "failed_step") -> DataFrame:
    """Name of the first step whose keep-condition does not hold, NULL for rows that pass all."""
    tag = F.lit(None).cast("string")
    for name, keep in reversed(steps):
        tag = F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)).otherwise(tag)
    return df.withColumn(out, tag)


def audit(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows removed and remaining per step, from one pass over the data.

    The running totals are computed on one row per step, never on the data.
    """
    tagged = tag_first_failure(df, steps)
    counts = tagged.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col("failed_step") == name).alias(f"_s{i}") for i, (name, _) in enumerate(steps)],
    )
    removed = [F.col(f"_s{i}") for i in range(len(steps))]
    cells = {}
    for i, (name, _) in enumerate(steps):
        gone = functools.reduce(lambda a, b: a + b, removed[: i + 1])
        cells[name] = {
            "step_no": F.lit(i + 1),
            "removed": removed[i],
            "remaining": F.col("_rows") - gone,
            "pct_removed": share_pct(removed[i], F.col("_rows")),
        }
    return unfold(counts, "step", cells)


