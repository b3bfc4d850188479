"""Material carbon and water, modal split, transport carbon and their combination."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.constants import QUICK_FREIGHT_G_PER_TKM
from weftline.functions.columns import all_of, literal_map, small_table, total
from weftline.operators.compose import parse_materials
from weftline.schema import TARGETS


class FactorTable:
    """Material factors: one (material, carbon, water) per name, for tables of any size.

    Rows without a name are dropped. Of several rows with one name the first counts: the one
    with the smallest ``order`` (any orderable column), or without it the smallest values;
    each metric takes the first row that has it. Up to 256 names become literals inside one
    projection, more are joined; both add up the same terms in the same order.
    """

    def __init__(
        self, factors: DataFrame, material="material", carbon="carbon", water="water", order: str | None = None
    ):
        named = factors.select(
            F.col(material).alias("material"),
            F.col(carbon).cast("double").alias("carbon"),
            F.col(water).cast("double").alias("water"),
            (F.lit(0) if order is None else F.col(order)).alias("_order"),
        ).where(F.col("material").isNotNull())
        first = {
            c: F.min(F.when(F.col(c).isNotNull(), F.struct("_order", c)))[c].alias(c) for c in ("carbon", "water")
        }
        self.table = named.groupBy("material").agg(*first.values())
        self.rows = small_table(self.table)

    def lookup(self, metric: str) -> Column | None:
        return None if self.rows is None else _literal_factors(self.rows, metric)

    def values(self, metric: str, vocabulary: list[str], default: float) -> list[float]:
        """Factor per vocabulary item, ``default`` when the table has none."""
        rows = self.table.where(F.col("material").isin(vocabulary)).collect() if self.rows is None else self.rows
        known = {r["material"]: r[metric] for r in rows if r[metric] is not None}
        return [float(known.get(m, default)) for m in vocabulary]


def _literal_factors(rows: list, metric: str) -> Column:
    known = {r["material"]: r[metric] for r in rows if r[metric] is not None}
    return literal_map(known) if known else F.create_map().cast("map<string,double>")


def _weighted(composition: Column, weight: Column, factors: Column) -> Column:
    """Sum over entries of weight * share * factor; repeated keys count each time."""
    return F.when(
        weight.isNotNull(),
        F.aggregate(
            F.map_entries(composition),
            F.lit(0.0),
            lambda acc, e: acc
            + weight
            * F.coalesce(e["value"], F.lit(0.0))
            * F.coalesce(F.element_at(factors, e["key"]), F.lit(0.0)),
        ),
    )


def material_footprint(
    df: DataFrame, factors: FactorTable, weight: str = "weight_kg", composition: str = "composition"
) -> DataFrame:
    """Add ``carbon_material`` and ``water_total``.

    Unknown materials and unparsable compositions add zero; a missing weight gives NULL.
    Few factors become literals inside one projection. More are joined to the entries of the
    distinct compositions, whose (share, factor) pairs are attached to their products: the
    work follows the number of different compositions and needs no unique row key. A stream
    can't be aggregated that way; with many factors its batches are computed one by one, see
    ``weftline.streaming.jobs.footprint_sink``.
    """
    known = F.col(weight).isNotNull()
    rows = factors.rows
    if rows is None and df.isStreaming:
        raise ValueError("too many factors for a projection over a stream; use footprint_sink")
    outputs = (("carbon_material", "carbon"), ("water_total", "water"))
    if rows is not None:
        weighted = {
            out: _weighted(F.col(composition), F.col(weight), _literal_factors(rows, metric)) for out, metric in outputs
        }
        return df.withColumns({out: F.when(known, F.coalesce(w, F.lit(0.0))) for out, w in weighted.items()})
    # a digest of the entries, in their order, stands for the composition; rows without one are
    # spread, as no digest looks like their keys
    entries = F.map_entries(composition)
    digest = lambda e: F.sha2(F.to_json(e), 256)
    spread = F.concat(F.lit("none-"), F.pmod(F.xxhash64(weight), F.lit(4096)).cast("string"))
    known_mixes = df.select(entries.alias("_entries")).where(F.col("_entries").isNotNull())
    # grouped by the entries themselves, so that no value has to be sorted along
    mixes = known_mixes.groupBy("_entries").agg(F.count(F.lit(1))).withColumn("_mix", digest(F.col("_entries")))
    parts = mixes.select("_mix", F.posexplode("_entries").alias("_pos", "e")).select(
        "_mix", "_pos", F.col("e.key").alias("material"), F.coalesce("e.value", F.lit(0.0)).alias("share")
    )
    terms = (
        parts.join(factors.table, "material", "left")
        .groupBy("_mix")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "share", "carbon", "water"))).alias("_terms"))
    )
    filled = df.withColumn("_mix", F.coalesce(digest(entries), spread)).join(terms, "_mix", "left")

    def amount(metric: str) -> Column:
        term = lambda t: F.col(weight) * t["share"] * F.coalesce(t[metric], F.lit(0.0))
        return F.aggregate("_terms", F.lit(0.0), lambda acc, t: acc + term(t))

    for out, metric in outputs:
        filled = filled.withColumn(out, F.when(known, F.coalesce(amount(metric), F.lit(0.0))))
    return filled.drop("_mix", "_terms")


class ModeTable:
    """Freight modes: (mode, ef, beta0, beta1). Every factor has to be positive."""

    def __init__(self, modes: DataFrame):
        # every mode is a column of the result, so the table is as small as a schema
        rows = modes.select("mode", "ef", "beta0", "beta1").orderBy("mode").collect()
        if not rows:
            raise ValueError("need at least one freight mode")
        bad = [r["mode"] for r in rows if r["ef"] is None or not r["ef"] > 0 or math.isinf(r["ef"])]
        if bad:
            raise ValueError(f"emission factors must be positive: {bad}")
        self.rows = [(r["mode"], float(r["ef"]), float(r["beta0"]), float(r["beta1"])) for r in rows]

    @property
    def names(self) -> list[str]:
        return [r[0] for r in self.rows]


def _with_weights(df: DataFrame, distance: str, modes: ModeTable) -> DataFrame:
    """Add exp(beta0 + beta1 ln d) per mode; NULL for a missing, zero, negative or infinite d.

    One logarithm and one exponential per mode. The terms stay short on purpose: a filter on
    a result is pushed below these steps and repeats them.
    """
    d = F.col(distance)
    logged = df.withColumn("_log_d", F.when((d > 0) & (d < F.lit(float("inf"))), F.ln(d)))
    return logged.withColumns(
        {f"_w_{m}": F.exp(F.lit(b0) + F.lit(b1) * F.col("_log_d")) for m, _, b0, b1 in modes.rows}
    ).drop("_log_d")


def with_modal_split(df: DataFrame, distance: str, modes: ModeTable, prefix: str = "p_") -> DataFrame:
    """Add the mode probabilities of a trip; NULL when the trip or a utility is not finite."""
    weights = [F.col(f"_w_{m}") for m in modes.names]
    whole = _with_weights(df, distance, modes).withColumn("_whole", total(weights))
    finite = F.col("_whole") < F.lit(float("inf"))
    out = whole.withColumns({f"{prefix}{m}": F.when(finite, F.col(f"_w_{m}") / F.col("_whole")) for m in modes.names})
    return out.drop("_whole", *[f"_w_{m}" for m in modes.names])


def with_emission_factor(df: DataFrame, distance: str, modes: ModeTable, out: str = "ef_weighted") -> DataFrame:
    """Add the expected g CO2e per tonne-kilometre over the modal split."""
    weighted = _with_weights(df, distance, modes)
    whole = total([F.col(f"_w_{m}") for m in modes.names])
    expected = total([F.col(f"_w_{m}") * F.lit(ef) for m, ef, _, _ in modes.rows]) / whole
    return weighted.withColumn(out, F.when(whole < F.lit(float("inf")), expected)).drop(
        *[f"_w_{m}" for m in modes.names]
    )


def with_emission_intensity(df: DataFrame, distance: str, modes: ModeTable, out: str = "kg_per_tkm") -> DataFrame:
    """Add kg CO2e per tonne-kilometre."""
    return with_emission_factor(df, distance, modes, out).withColumn(out, F.col(out) / 1000.0)


def valid_trip(weight: Column, distance: Column) -> Column:
    finite = F.lit(float("inf"))
    return F.coalesce(
        (weight > 0) & (weight < finite) & (distance > 0) & (distance < finite), F.lit(False)
    )


def with_transport_carbon(
    df: DataFrame, weight: str, distance: str, modes: ModeTable, out: str = "carbon_transport"
) -> DataFrame:
    """Add kg CO2e of the trip; an invalid trip counts as zero."""
    carbon = F.col(weight) / 1000.0 * F.col(distance) * F.col("_ef") / 1000.0
    valid = valid_trip(F.col(weight), F.col(distance))
    return (
        with_emission_factor(df, distance, modes, "_ef")
        .withColumn(out, F.when(valid, F.coalesce(carbon, F.lit(0.0))).otherwise(F.lit(0.0)))
        .drop("_ef")
    )


def modal_split_check(df: DataFrame, distance: str, modes: ModeTable, tolerance: float = 1e-6) -> DataFrame:
    """Flag rows whose probabilities leave [0, 1] or do not add up to one."""
    split = with_modal_split(df, distance, modes)
    parts = [F.col(f"p_{m}") for m in modes.names]
    in_range = all_of([(p >= 0) & (p <= 1) for p in parts])
    checked = split.withColumn("probability_sum", total(parts))
    return checked.withColumn(
        "split_valid",
        F.coalesce(in_range & (F.abs(F.col("probability_sum") - 1.0) <= tolerance), F.lit(False)),
    )


def has_composition_text(materials: Column) -> Column:
    return materials.isNotNull() & (F.trim(materials) != "")


NO_COMPOSITION = "no composition text"


def footprint_or_reason(
    df: DataFrame,
    factors: FactorTable,
    modes: ModeTable,
    materials: str = "materials",
    weight: str = "weight_kg",
    distance: str = "total_distance_km",
    counts: Observation | None = None,
) -> DataFrame:
    """Every row with its four footprint columns, or with NULL there and a ``reason``.

    One projection over one scan: accepted and rejected rows are told apart at the sink.
    ``counts`` observes the numbers of accepted and rejected rows while the result is written.
    """
    text = F.col(materials)
    marked = df.withColumn("reason", F.when(~has_composition_text(text), F.lit(NO_COMPOSITION))).withColumn(
        "composition", F.when(F.col("reason").isNull(), parse_materials(text))
    )
    with_material = material_footprint(marked, factors, weight).drop("composition")
    done = with_transport_carbon(with_material, weight, distance, modes).withColumn(
        "carbon_total", F.col("carbon_material") + F.col("carbon_transport")
    )
    out = done.withColumns({t: F.when(F.col("reason").isNull(), F.col(t)) for t in TARGETS})
    if counts is None:
        return out
    return out.observe(
        counts, F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("rejected")
    )


def write_footprints(
    df: DataFrame, factors: FactorTable, modes: ModeTable, path: str, **columns: str
) -> dict[str, int]:
    """Write accepted and rejected rows below ``path`` in one pass; their numbers are returned.

    The folders are ``rejected=false`` and ``rejected=true``.
    """
    counts = Observation()
    rows = footprint_or_reason(df, factors, modes, counts=counts, **columns)
    marked = rows.withColumn("rejected", F.col("reason").isNotNull())
    marked.write.mode("overwrite").partitionBy("rejected").parquet(path)
    return counts.get


def product_footprint(
    df: DataFrame,
    factors: FactorTable,
    modes: ModeTable,
    materials: str = "materials",
    weight: str = "weight_kg",
    distance: str = "total_distance_km",
) -> DataFrame:
    """Add the four footprint columns; rows without composition text are left out.

    One projection over the scan with literal factors. :func:`footprint_rejects` returns the
    rows left out here, :func:`footprint_or_reason` both kinds in one pass.
    """
    accepted = df.where(has_composition_text(F.col(materials))).withColumn(
        "composition", parse_materials(F.col(materials))
    )
    with_material = material_footprint(accepted, factors, weight).drop("composition")
    return with_transport_carbon(with_material, weight, distance, modes).withColumn(
        "carbon_total", F.col("carbon_material") + F.col("carbon_transport")
    )


def footprint_rejects(df: DataFrame, materials: str = "materials") -> DataFrame:
    return df.where(~has_composition_text(F.col(materials))).withColumn("reason", F.lit(NO_COMPOSITION))


def mode_average_factor(
    subtypes: DataFrame, mode: str = "mode", factor: str = "ef", share: str = "share", tolerance: float = 0.01
) -> DataFrame:
    """Factor per mode as the usage-weighted mean of its subtypes, with a check of the share sum."""
    return (
        subtypes.groupBy(mode)
        .agg(
            F.sum(F.col(factor) * F.col(share)).alias("ef"),
            F.sum(share).alias("share_sum"),
            F.count(F.lit(1)).alias("n_subtypes"),
        )
        .withColumn("share_ok", F.abs(F.col("share_sum") - 1.0) <= tolerance)
    )


def formula_features(
    df: DataFrame,
    factors: FactorTable,
    vocabulary: list[str],
    weight: str = "weight_kg",
    distance: str = "total_distance_km",
    freight: float = QUICK_FREIGHT_G_PER_TKM,
) -> DataFrame:
    """Quick estimates from share columns with a constant freight factor; NULL when inputs lack."""
    from weftline.operators.compose import share_total

    has_materials = share_total(vocabulary) > 0
    known = F.col(weight).isNotNull() & has_materials

    def estimate(metric: str) -> Column:
        pairs = zip(vocabulary, factors.values(metric, vocabulary, 0.0))
        intensity = total([F.coalesce(F.col(m), F.lit(0.0)) * F.lit(f) for m, f in pairs])
        return F.when(known, F.col(weight) * intensity)

    return df.withColumns(
        {
            "formula_carbon_material": estimate("carbon"),
            "formula_carbon_transport": F.col(weight) / 1000.0 * F.col(distance) * F.lit(freight / 1000.0),
            "formula_water_total": estimate("water"),
        }
    )


def footprint_rollup(df: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """Counts, totals and means of the measures per value of every dimension, in one shuffle."""
    long = df.select(
        *measures,
        F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])).alias("d"),
    ).where(F.col("d.value").isNotNull())
    return long.groupBy("d.dim", "d.value").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(m).alias(f"sum_{m}") for m in measures],
        *[F.avg(m).alias(f"avg_{m}") for m in measures],
    )


def factor_ranking(factors: DataFrame, k: int = 10, material: str = "material", carbon: str = "carbon") -> DataFrame:
    """The k materials with the highest carbon factor; ties go by name."""
    return factors.select(material, carbon).orderBy(F.col(carbon).desc(), F.col(material)).limit(k)
