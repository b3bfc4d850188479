"""Material compositions: parse, explode, pivot, check and normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.constants import ALIASES, MATERIALS
from weftline.functions.columns import any_of, literal_array, literal_map, once, total

MAP_TYPE = "map<string,double>"
TEXT_MAP = "map<string,string>"
_LENIENT = {"allowUnquotedFieldNames": "true"}


def parse_materials(materials: Column) -> Column:
    """JSON object text -> map of shares; NULL for anything that is not an object.

    All names are kept: a share that is no number (``"50%"``, ``true``, an object) is NULL, a
    number in quotes counts. Single-quoted and unquoted keys are accepted, doubled quotes are
    tried as a second form.
    """
    return F.transform_values(parse_texts(materials), lambda _, share: share.try_cast("double"))


def parse_texts(materials: Column) -> Column:
    """As :func:`parse_materials`, with the shares as they are written."""
    strict = F.from_json(materials, TEXT_MAP, _LENIENT)
    doubled = F.from_json(F.replace(materials, F.lit('""'), F.lit('"')), TEXT_MAP, _LENIENT)
    return F.coalesce(strict, doubled)


def with_composition(df: DataFrame, materials: str = "materials", out: str = "composition") -> DataFrame:
    return df.withColumn(out, once(parse_materials(F.col(materials))))


def last_wins(entries: Column, kind: str = MAP_TYPE) -> Column:
    """Fold (key, value) structs into a map; a repeated key keeps its last value."""
    return F.aggregate(
        entries,
        F.create_map().cast(kind),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])
        ),
    )


def unique_keys(composition: Column) -> Column:
    """The composition with each key once; maps without repeated keys pass through untouched."""
    repeated = F.size(F.array_distinct(F.map_keys(composition))) != F.size(composition)
    return F.when(repeated, last_wins(F.map_entries(composition))).otherwise(composition)


def rename_keys(composition: Column, mapping: dict[str, str], clean=lambda key: key, kind: str = MAP_TYPE) -> Column:
    """Rename map keys; when two keys end up equal the later entry is kept."""
    names = literal_map(mapping)
    renamed = F.transform(
        F.map_entries(composition),
        lambda e: F.struct(
            F.coalesce(F.element_at(names, clean(e["key"])), clean(e["key"])).alias("key"),
            e["value"].alias("value"),
        ),
    )
    return last_wins(renamed, kind)


def composition_text(texts: Column) -> Column:
    """JSON text of a map of shares as the parser gives them; numbers are not converted."""
    escaped = lambda x: F.concat(
        F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')
    )
    plain = lambda v: v.try_cast("double").isNotNull() | v.isin("true", "false") | v.rlike(r"^[\[{]")
    entry = lambda e: F.concat(
        escaped(e["key"]),
        F.lit(": "),
        F.when(e["value"].isNull(), "null").when(plain(e["value"]), e["value"]).otherwise(escaped(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(texts), entry), ", "), F.lit("}"))


def normalise_aliases(composition: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower-case and trim names, then replace aliases by canonical names."""
    return rename_keys(composition, ALIASES if aliases is None else aliases, lambda key: F.lower(F.trim(key)))


def explode_materials(df: DataFrame, keep: list[str], composition: str = "composition") -> DataFrame:
    """One row per (product, material, share).

    A plain explode would bring a filter on the size of the composition, which is pushed down
    and parses the text a second time; rows without entries are dropped afterwards instead.
    """
    entries = df.select(*keep, F.explode_outer(composition).alias("material", "share"))
    return entries.where(F.col("material").isNotNull())


def pivot_materials(
    df: DataFrame, vocabulary: list[str] | None = None, composition: str = "composition"
) -> DataFrame:
    """Composition map -> one share column per vocabulary item; a projection, no shuffle.

    Entries are de-duplicated once (last one wins). A lookup per column would search the map as
    often as the vocabulary has names; the parser of a struct of the names meets each entry once.
    """
    names = list(dict.fromkeys(MATERIALS if vocabulary is None else vocabulary))
    struct = T.StructType([T.StructField(m, T.DoubleType()) for m in names])
    shares = F.from_json(F.to_json(unique_keys(F.col(composition))), struct)
    return df.withColumn("_shares", once(shares)).withColumns(
        {m: F.coalesce(F.col("_shares").getField(m), F.lit(0.0)) for m in names}
    ).drop("_shares")


def unpivot_materials(
    df: DataFrame, keep: list[str], vocabulary: list[str] | None = None, drop_zero: bool = True
) -> DataFrame:
    """Share columns -> (material, share) rows; zero shares are not materialised by default."""
    names = MATERIALS if vocabulary is None else vocabulary
    cells = F.array(*[F.struct(F.lit(m).alias("material"), F.col(m).alias("share")) for m in names])
    if drop_zero:
        cells = F.filter(cells, lambda c: c["share"] != 0)
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.material", "c.share")


def share_sum(composition: Column) -> Column:
    return F.aggregate(F.map_values(composition), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def composition_check(
    df: DataFrame,
    tolerance: float = 0.01,
    vocabulary: list[str] | None = None,
    composition: str = "composition",
) -> DataFrame:
    """Flags per product: shares in range, sum close to one, unknown names and the share they hold."""
    known = literal_array(MATERIALS if vocabulary is None else vocabulary)
    comp = F.col(composition)
    unknown = F.filter(F.map_entries(comp), lambda e: ~F.array_contains(known, e["key"]))
    return df.withColumns(
        {
            "share_sum": share_sum(comp),
            "shares_in_range": F.forall(F.map_values(comp), lambda x: (x >= 0) & (x <= 1)),
            "sum_ok": F.abs(share_sum(comp) - 1.0) <= F.lit(tolerance),
            "has_unknown": F.size(unknown) > 0,
            "unknown_share": F.aggregate(
                unknown, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["value"], F.lit(0.0))
            ),
        }
    )


def material_diversity(composition: Column) -> dict[str, Column]:
    """Number of materials with a positive share and the Shannon entropy of the shares."""
    positive = F.filter(F.map_values(composition), lambda p: p > 0)
    return {
        "n_materials": F.size(positive),
        "entropy": F.aggregate(positive, F.lit(0.0), lambda acc, p: acc - p * F.ln(p + F.lit(1e-10))),
    }


def share_total(vocabulary: list[str] | None = None) -> Column:
    """Sum of the share columns; zero means the materials of the product are missing."""
    return total([F.coalesce(F.col(m), F.lit(0.0)) for m in (MATERIALS if vocabulary is None else vocabulary)])


def may_name(materials: Column, names: list[str]) -> Column:
    """False when the text cannot name any of ``names``: it holds none of them and no escape.

    Plain substring tests, cheaper than the JSON parser they spare; NULL text gives false.
    """
    return F.coalesce(any_of([materials.contains(n) for n in [*names, "\\"]]), F.lit(False))


def text_names_any(materials: Column, names: list[str]) -> Column:
    """:func:`names_any` on JSON text; only suspicious texts are parsed."""
    return may_name(materials, names) & names_any(parse_materials(materials), names)


def names_any(composition: Column, names: list[str]) -> Column:
    """True when the composition names at least one of ``names``; NULL compositions give false."""
    return F.coalesce(F.arrays_overlap(F.map_keys(composition), literal_array(names)), F.lit(False))
