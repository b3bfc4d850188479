"""Model features: interactions, intensities, encodings and scaling.

Row-level features are projections. Everything fitted is a small table or a handful of
numbers: per-key statistics come from one aggregation over (key, fold) and are joined back
as a written table, whose measured size decides between broadcast and shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.constants import (
    DEFAULT_CARBON_FACTOR,
    DEFAULT_WATER_FACTOR,
    HIGH_CARBON,
    MATERIALS,
    NATURAL,
    SYNTHETIC,
)
from weftline.functions.columns import literal_map, total
from weftline.functions.folds import UNKNOWN, fold_of, fold_others, fold_totals
from weftline.functions.ranking import exact_quantiles, numbered
from weftline.operators.compose import share_total
from weftline.operators.emissions import FactorTable, formula_features
from weftline.schema import CATEGORICALS, NUMERICS
from weftline.session import persist_state

FORMULA = ["formula_carbon_material", "formula_carbon_transport", "formula_water_total"]
ENCODED_TARGETS = ["carbon_material", "carbon_transport", "water_total"]
INTERACTIONS = [
    "primary_material_pct", "material_diversity", "weight_x_primary_pct", "weight_x_total_material",
    "high_carbon_material_pct", "synthetic_material_pct", "natural_material_pct",
    "weight_x_high_carbon", "weight_x_synthetic", "weight_x_natural",
]
INTENSITIES = [
    "material_carbon_intensity", "material_water_intensity", "weight_x_carbon_intensity",
    "weight_x_water_intensity",
]
FALLBACK = [
    "dominant_material_idx", "dominant_material_carbon", "dominant_material_water",
    "is_high_impact_material", "max_material_carbon_factor", "max_material_water_factor",
]
CATEGORY_FALLBACK = [
    "category_avg_carbon", "category_avg_water", "category_avg_weight", "category_median_carbon",
    "parent_category_avg_carbon", "parent_category_avg_water", "global_avg_carbon",
    "global_avg_water",
]
CROSS = [
    "category_x_carbon_intensity", "category_x_water_intensity", "category_material_avg_carbon",
    "category_material_avg_water",
]
IMPUTATION = ["weight_imputed", "weight_is_imputed", "formula_is_available", "any_critical_missing"]
MISSING = [
    "weight_kg_missing", "total_distance_km_missing", "materials_missing", "category_missing",
    "parent_category_missing", "gender_missing",
]


def target_feature(column: str, target: str) -> str:
    return f"{column}_target_{target.replace('_', '')}"


def feature_names(formula: bool = True) -> list[str]:
    """The model columns in order: 93 with the formula features, 90 without."""
    names = [f"{c}_encoded" for c in CATEGORICALS]
    names += [target_feature(c, t) for c in CATEGORICALS for t in ENCODED_TARGETS]
    names += NUMERICS + MATERIALS + INTERACTIONS + INTENSITIES + FALLBACK + CATEGORY_FALLBACK
    names += CROSS + IMPUTATION + MISSING
    return names + FORMULA if formula else names


# --- row-level features -------------------------------------------------------------------


def _share(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _shares() -> Column:
    return F.array(*[_share(m) for m in MATERIALS])


def _weight() -> Column:
    return F.coalesce(F.col("weight_kg"), F.lit(0.0))


def interaction_features(df: DataFrame) -> DataFrame:
    """Largest share, number of materials, group shares and their products with the weight."""
    largest = F.greatest(*[_share(m) for m in MATERIALS])
    groups = {
        "high_carbon": total([_share(m) for m in HIGH_CARBON]),
        "synthetic": total([_share(m) for m in SYNTHETIC]),
        "natural": total([_share(m) for m in NATURAL]),
    }
    return df.withColumns(
        {
            "primary_material_pct": largest,
            "material_diversity": total([(_share(m) > 0).cast("int") for m in MATERIALS]),
            "weight_x_primary_pct": _weight() * largest,
            "weight_x_total_material": _weight() * share_total(),
        }
        | {f"{g}_material_pct": e for g, e in groups.items()}
        | {f"weight_x_{g}": _weight() * e for g, e in groups.items()}
    )


def intensity_features(
    df: DataFrame,
    factors: FactorTable,
    default_carbon: float = DEFAULT_CARBON_FACTOR,
    default_water: float = DEFAULT_WATER_FACTOR,
) -> DataFrame:
    """Factor-weighted shares per kg of the mix, alone and times the weight."""

    def intensity(metric: str, default: float) -> Column:
        values = factors.values(metric, MATERIALS, default)
        return total([_share(m) * F.lit(f) for m, f in zip(MATERIALS, values)])

    carbon, water = intensity("carbon", default_carbon), intensity("water", default_water)
    return df.withColumns({"material_carbon_intensity": carbon, "material_water_intensity": water}).withColumns(
        {
            "weight_x_carbon_intensity": _weight() * F.col("material_carbon_intensity"),
            "weight_x_water_intensity": _weight() * F.col("material_water_intensity"),
        }
    )


def material_fallback(
    df: DataFrame,
    factors: FactorTable,
    default_carbon: float = DEFAULT_CARBON_FACTOR,
    default_water: float = DEFAULT_WATER_FACTOR,
) -> DataFrame:
    """The dominant material (first of equals, index 0 when there is none) and its factors."""
    carbon = F.array(*[F.lit(x) for x in factors.values("carbon", MATERIALS, default_carbon)])
    water = F.array(*[F.lit(x) for x in factors.values("water", MATERIALS, default_water)])

    def strongest(values: Column) -> Column:
        return F.array_max(F.zip_with("_shares", values, lambda s, f: F.when(s > 0, f).otherwise(0.0)))

    marked = df.withColumn("_shares", _shares()).withColumn(
        "dominant_material_idx", (F.array_position("_shares", F.array_max("_shares")) - 1).cast("int")
    )
    return marked.withColumns(
        {
            "dominant_material_carbon": F.get(carbon, F.col("dominant_material_idx")),
            "dominant_material_water": F.get(water, F.col("dominant_material_idx")),
            "is_high_impact_material": (total([_share(m) for m in HIGH_CARBON]) > 0.1).cast("int"),
            "max_material_carbon_factor": strongest(carbon),
            "max_material_water_factor": strongest(water),
        }
    ).drop("_shares")


def missing_indicators(df: DataFrame) -> DataFrame:
    flags = {f"{c}_missing": F.col(c).isNull() for c in ("weight_kg", "total_distance_km")}
    flags["materials_missing"] = share_total() == 0
    flags |= {f"{c}_missing": F.col(c).isNull() for c in ("category", "parent_category", "gender")}
    return df.withColumns({name: e.cast("int") for name, e in flags.items()})


def imputation_features(df: DataFrame, weight_median: float | None) -> DataFrame:
    """Median-filled weight and flags that say which inputs were there."""
    no_weight, no_materials = F.col("weight_kg").isNull(), share_total() == 0
    return df.withColumns(
        {
            "weight_imputed": F.coalesce(F.col("weight_kg"), F.lit(weight_median)),
            "weight_is_imputed": no_weight.cast("int"),
            "formula_is_available": (~no_weight & (share_total() > 0)).cast("int"),
            "any_critical_missing": (no_weight | no_materials | F.col("total_distance_km").isNull()).cast("int"),
        }
    )


def log_shift(df: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """ln(1 + (x - min + 1)) per column, with the fitted minimum."""
    return df.withColumns({c: F.log1p(F.col(c) - F.lit(m) + 1.0) for c, m in minimums.items() if m is not None})


def scale_numeric(df: DataFrame, stats: dict[str, dict[str, float]]) -> DataFrame:
    """(x - mean) / population std after filling gaps with the median."""
    return df.withColumns(
        {
            c: (F.coalesce(F.col(c), F.lit(s["median"])) - F.lit(s["mean"])) / F.lit(s["std"] or 1.0)
            for c, s in stats.items()
        }
    )


def missing_pattern(df: DataFrame, materials: str = "materials", out: str = "missing_pattern") -> DataFrame:
    """Letters of the missing fields joined by '_', COMPLETE when none is missing."""
    letters = {"C": "category", "W": "weight_kg", "D": "total_distance_km", "M": materials}
    text = F.concat_ws("_", *[F.when(F.col(c).isNull(), F.lit(letter)) for letter, c in letters.items()])
    return df.withColumn(out, F.when(text == "", "COMPLETE").otherwise(text))


# --- fitted numbers -----------------------------------------------------------------------


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns in one pass."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("x")
    ).select("x.c", "x.v")
    found = {r["c"]: r["median"] for r in exact_quantiles(long, "v", {"median": 0.5}, ["c"]).collect()}
    return {c: found.get(c) for c in columns}


def fit_scaler(df: DataFrame, columns: list[str], medians: dict[str, float | None]) -> dict[str, dict[str, float]]:
    """Mean and population std of the median-filled columns."""
    filled = {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns}
    row = df.agg(
        *[F.avg(e).alias(f"{c}_mean") for c, e in filled.items()],
        *[F.stddev_pop(e).alias(f"{c}_std") for c, e in filled.items()],
    ).first()
    return {c: {"median": medians[c], "mean": row[f"{c}_mean"], "std": row[f"{c}_std"]} for c in columns}


def fit_minimums(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.min(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


# --- label encoding -----------------------------------------------------------------------


def fit_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key_name, key_value, code): codes 0..k-1 in sorted order of the distinct values.

    Values are ordered by ranges, so a column with very many values isn't one task.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("key_name"), F.coalesce(F.col(c), F.lit(UNKNOWN)).alias("key_value")) for c in columns]
    )
    return _codes(df.select(F.explode(pairs).alias("p")).select("p.*"))


def _codes(pairs: DataFrame) -> DataFrame:
    distinct = persist_state(pairs.distinct(), "labels")
    return persist_state(numbered(distinct, "key_name", "key_value", "code"), "labels")


def label_encode(df: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_encoded``; a value not seen at fit time gets -1."""
    for c in columns:
        side = labels.where(F.col("key_name") == c).select(F.col("key_value").alias("_key"), F.col("code").alias("_code"))
        df = (
            df.join(side, F.coalesce(F.col(c), F.lit(UNKNOWN)) == F.col("_key"), "left")
            .withColumn(f"{c}_encoded", F.coalesce("_code", F.lit(-1)))
            .drop("_key", "_code")
        )
    return df


# --- out-of-fold statistics ---------------------------------------------------------------


def fit_fold_statistics(
    df: DataFrame, values: list[str], folds: int = 5, fold: str = "fold", median: str | None = "carbon_material"
) -> DataFrame:
    """Out-of-fold means and counts for the three categoricals and the whole table, plus the
    out-of-fold median of ``median`` per category; one small written table."""
    means = fold_others(fold_totals(df, CATEGORICALS, values, fold), values, folds, fold)
    return persist_state(_with_medians(means, df, median, folds, fold), "fold-statistics")


def _with_medians(means: DataFrame, df: DataFrame, median: str | None, folds: int, fold: str) -> DataFrame:
    if median is None:
        return means
    pairs = F.array(
        F.struct(F.lit("*").alias("key_name"), F.lit("*").alias("key_value")),
        F.struct(F.lit("category").alias("key_name"), F.coalesce("category", F.lit(UNKNOWN)).alias("key_value")),
    )
    stored = persist_state(df.select("category", fold, median), "values")
    medians = exact_quantiles(
        stored.select(fold, median, F.explode(pairs).alias("p")).select("p.*", fold, median),
        median,
        {"carbon_median": 0.5},
        ["key_name", "key_value"],
        leave_out=(fold, folds),
        stored=True,
    )
    return means.join(medians, ["key_name", "key_value", "held_out"], "left")


def _overall(stats: DataFrame) -> dict[int, dict]:
    """Whole-table statistics per held-out fold: folds + 1 rows."""
    return {r["held_out"]: r.asDict() for r in stats.where(F.col("key_name") == "*").collect()}


def _by_fold(overall: dict[int, dict], name: str, fold: str) -> Column:
    known = {k: v[name] for k, v in overall.items() if v[name] is not None}
    return F.element_at(literal_map(known), F.col(fold))


def _joined(key: str, name: str) -> Column:
    return F.col(f"_{key}__{name}")


def _join_statistics(df: DataFrame, stats: DataFrame, wanted: dict[str, list[str]], fold: str) -> DataFrame:
    """One join per categorical column: ``{column: statistics}`` as ``_<column>__<statistic>``."""
    for key, names in wanted.items():
        side = stats.where(F.col("key_name") == key).select(
            F.col("key_value").alias("_key"),
            F.col("held_out").alias("_held"),
            *[F.col(n).alias(f"_{key}__{n}") for n in names],
        )
        match = (F.coalesce(F.col(key), F.lit(UNKNOWN)) == F.col("_key")) & (F.col(fold) == F.col("_held"))
        df = df.join(side, match, "left").drop("_key", "_held")
    return df


def _drop_joined(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    return df.drop(*[f"_{key}__{n}" for key, names in wanted.items() for n in names])


_FALLBACK_OF = {
    "category": ["carbon_material_mean", "water_total_mean", "weight_kg_mean", "carbon_median"],
    "parent_category": ["carbon_material_mean", "water_total_mean"],
}
_CROSS_OF = {"category": ["material_carbon_intensity_mean", "material_water_intensity_mean"]}


def _fallback_columns(overall: dict[int, dict], fold: str) -> dict[str, Column]:
    def known(key: str, name: str) -> Column:
        return F.coalesce(_joined(key, name), _by_fold(overall, name, fold))

    carbon, water = "carbon_material_mean", "water_total_mean"
    return {
        "category_avg_carbon": known("category", carbon),
        "category_avg_water": known("category", water),
        "category_avg_weight": known("category", "weight_kg_mean"),
        "category_median_carbon": known("category", "carbon_median"),
        "parent_category_avg_carbon": known("parent_category", carbon),
        "parent_category_avg_water": known("parent_category", water),
        "global_avg_carbon": F.lit(overall[-1][carbon]),
        "global_avg_water": F.lit(overall[-1][water]),
    }


def _cross_columns(overall: dict[int, dict], max_code: int, fold: str) -> dict[str, Column]:
    scaled = F.col("category_encoded") / F.lit(float(max_code)) if max_code > 0 else F.col("category_encoded")
    out = {}
    for metric in ("carbon", "water"):
        mean = f"material_{metric}_intensity_mean"
        out[f"category_x_{metric}_intensity"] = scaled * F.col(f"material_{metric}_intensity")
        out[f"category_material_avg_{metric}"] = F.coalesce(_joined("category", mean), _by_fold(overall, mean, fold))
    return out


def _target_columns(
    overall: dict[int, dict], columns: list[str], targets: list[str], smoothing: float, fold: str
) -> dict[str, Column]:
    out = {}
    for c in columns:
        for t in targets:
            n, mean, everywhere = _joined(c, f"{t}_n"), _joined(c, f"{t}_mean"), _by_fold(overall, f"{t}_mean", fold)
            out[target_feature(c, t)] = F.coalesce((n * mean + smoothing * everywhere) / (n + smoothing), everywhere)
    return out


def _target_statistics(columns: list[str], targets: list[str]) -> dict[str, list[str]]:
    return {c: [f"{t}_{kind}" for t in targets for kind in ("mean", "n")] for c in columns}


def category_fallback(df: DataFrame, stats: DataFrame, fold: str = "fold") -> DataFrame:
    """Means and median per category and parent outside the row's own fold.

    Fold -1 (rows not used for fitting) reads the statistics over all rows. Values without
    statistics fall back to those of the whole table outside the fold.
    """
    out = _join_statistics(df, stats, _FALLBACK_OF, fold)
    return _drop_joined(out.withColumns(_fallback_columns(_overall(stats), fold)), _FALLBACK_OF)


def cross_features(df: DataFrame, stats: DataFrame, max_code: int, fold: str = "fold") -> DataFrame:
    """Encoded category scaled by the fitted largest code times the intensity, and the
    out-of-fold mean intensity of the category."""
    out = _join_statistics(df, stats, _CROSS_OF, fold)
    return _drop_joined(out.withColumns(_cross_columns(_overall(stats), max_code, fold)), _CROSS_OF)


def target_encode(
    df: DataFrame,
    stats: DataFrame,
    columns: list[str] | None = None,
    targets: list[str] | None = None,
    smoothing: float = 20.0,
    fold: str = "fold",
) -> DataFrame:
    """(n * mean + s * overall) / (n + s) outside the fold, per categorical and target."""
    columns = CATEGORICALS if columns is None else columns
    targets = ENCODED_TARGETS if targets is None else targets
    wanted = _target_statistics(columns, targets)
    out = _join_statistics(df, stats, wanted, fold)
    return _drop_joined(out.withColumns(_target_columns(_overall(stats), columns, targets, smoothing, fold)), wanted)


def group_median_impute(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Fill gaps with the median of the row's group: ``{column: group column}``."""
    for column, group in rules.items():
        medians = persist_state(
            exact_quantiles(df.select(group, column), column, {"_median": 0.5}, [group]), "group-medians"
        ).withColumnRenamed(group, "_group")
        df = (
            df.join(medians, F.col(group) == F.col("_group"), "left")
            .withColumn(column, F.coalesce(F.col(column), F.col("_median")))
            .drop("_group", "_median")
        )
    return df


# --- the fitted preprocessor --------------------------------------------------------------

STATISTICS_OF = [*ENCODED_TARGETS, "weight_kg", "material_carbon_intensity", "material_water_intensity"]


@dataclass
class Preprocessor:
    """Fit once on the training part, then transform any table with the same columns.

    The state is one wide table with a row per (categorical column, value, held-out fold):
    label code, out-of-fold means, counts and median. A transform joins it three times, once
    per categorical; the rest is numbers.
    """

    factors: FactorTable
    key: str = "product_id"
    folds: int = 5
    seed: int = 42
    smoothing: float = 20.0
    freight: float = 50.0
    state: DataFrame | None = None
    numbers: dict = field(default_factory=dict)

    def _row_level(self, df: DataFrame) -> DataFrame:
        df = formula_features(df, self.factors, MATERIALS, freight=self.freight)
        return intensity_features(interaction_features(df), self.factors)

    def fit(self, df: DataFrame) -> Preprocessor:
        """The source is read once; what the statistics need of it is written as a narrow table."""
        base = self._row_level(df).withColumn("fold", fold_of(F.col(self.key), self.folds, self.seed))
        narrow = list(dict.fromkeys(["fold", *CATEGORICALS, *STATISTICS_OF, *NUMERICS, *FORMULA]))
        rows = persist_state(base.select(*narrow), "fit")
        totals = persist_state(fold_totals(rows, CATEGORICALS, STATISTICS_OF), "fold-totals")
        labels = _codes(totals.where(F.col("key_name") != "*").select("key_name", "key_value"))
        means = fold_others(totals, STATISTICS_OF, self.folds)
        state = _with_medians(means, rows, "carbon_material", self.folds, "fold")
        self.state = persist_state(state.join(labels, ["key_name", "key_value"], "left"), "fold-statistics")
        top = labels.where(F.col("key_name") == "category").agg(F.max("code")).first()[0]
        medians = fit_medians(rows, NUMERICS)
        self.numbers = {
            "max_code": int(top or 0),
            "scaler": fit_scaler(rows, NUMERICS, medians),
            "minimums": fit_minimums(rows, FORMULA),
        }
        return self

    def transform(self, df: DataFrame, training: bool = False, keep: list[str] | None = None) -> DataFrame:
        """The 93 feature columns, after the columns named in ``keep``."""
        if self.state is None:
            raise ValueError("fit the preprocessor before transforming")
        fold = fold_of(F.col(self.key), self.folds, self.seed) if training else F.lit(-1)
        out = self._row_level(df).withColumn("fold", fold)
        out = material_fallback(missing_indicators(out), self.factors)
        out = imputation_features(out, self.numbers["scaler"]["weight_kg"]["median"])
        wanted = _target_statistics(CATEGORICALS, ENCODED_TARGETS)
        for more in ({c: ["code"] for c in CATEGORICALS}, _FALLBACK_OF, _CROSS_OF):
            wanted = {c: list(dict.fromkeys([*names, *more.get(c, [])])) for c, names in wanted.items()}
        overall = _overall(self.state)
        out = _join_statistics(out, self.state, wanted, "fold").withColumns(
            {f"{c}_encoded": F.coalesce(_joined(c, "code"), F.lit(-1)) for c in CATEGORICALS}
        )
        out = out.withColumns(
            _fallback_columns(overall, "fold")
            | _cross_columns(overall, self.numbers["max_code"], "fold")
            | _target_columns(overall, CATEGORICALS, ENCODED_TARGETS, self.smoothing, "fold")
        )
        out = log_shift(scale_numeric(out, self.numbers["scaler"]), self.numbers["minimums"])
        kept = [c for c in keep or [] if c not in feature_names()]
        return out.select(*kept, *feature_names())

    def save(self, path: str) -> None:
        """Write the state below ``path``: two Parquet tables and one JSON line."""
        spark = self.state.sparkSession
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        self.factors.table.write.mode("overwrite").parquet(f"{path}/factors")
        settings = {k: getattr(self, k) for k in ("key", "folds", "seed", "smoothing", "freight", "numbers")}
        spark.range(1).select(F.lit(json.dumps(settings)).alias("value")).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        numbers = settings.pop("numbers")
        return cls(
            factors=FactorTable(spark.read.parquet(f"{path}/factors")),
            state=spark.read.parquet(f"{path}/state"),
            numbers=numbers,
            **settings,
        )
