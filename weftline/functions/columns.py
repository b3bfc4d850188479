"""Small column helpers shared by the operators."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LITERAL_ENTRIES = 256


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column; run once at ingest."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def literal_map(entries: dict) -> Column:
    """A constant map column; empty input gives an empty string->string map."""
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(value: Column) -> Column:
    """The same value, worked out once per row and only where its column is used.

    The optimiser copies the expression of a column into every filter above it and into each of
    their terms, so a costly one is repeated many times per row. A condition it can't foresee
    (it always holds, as ``rand`` is never negative) keeps the expression where it is.
    """
    return F.when(F.rand(0) + 1.0 > 0.0, value)


def total(columns: Iterable[Column]) -> Column:
    """Left-to-right sum of columns."""
    return functools.reduce(operator.add, columns)


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def share_pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, NULL when the whole is zero."""
    return F.when(whole != 0, part.cast("double") * 100.0 / whole)


def values_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A constant parameter table whose size the optimiser knows exactly."""
    data = {name: [row[i] for row in rows] for i, name in enumerate(columns)}
    return spark.createDataFrame(pa.table(data))


def small_table(df: DataFrame, limit: int = MAX_LITERAL_ENTRIES) -> list | None:
    """Rows of a parameter table, or None when it has more than ``limit`` rows.

    At most ``limit + 1`` rows ever reach the driver, whatever the size of the table.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def in_band(value: Column, low, low_closed: bool, high, high_closed: bool) -> Column:
    """Interval test with open or closed ends; ``None`` is an unbounded end."""
    tests = []
    if low is not None:
        tests.append(value >= low if low_closed else value > low)
    if high is not None:
        tests.append(value <= high if high_closed else value < high)
    return all_of(tests) if tests else value.isNotNull()


def band_label(value: Column, bands: list[tuple]) -> Column:
    """Label of the first band that holds the value, NULL when none does."""
    label = F.lit(None).cast("string")
    for name, low, low_closed, high, high_closed in reversed(bands):
        label = F.when(in_band(value, low, low_closed, high, high_closed), F.lit(name)).otherwise(label)
    return label


def rename_expr(value: Column, mapping: dict[str, str]) -> Column:
    """Replace values found in ``mapping`` and keep the rest."""
    chained = set(mapping.values()) & {k for k, v in mapping.items() if k != v}
    if chained:
        raise ValueError(f"targets that are also sources make the result order-dependent: {sorted(chained)}")
    return F.coalesce(F.element_at(literal_map(mapping), value), value) if mapping else value
