"""I-Match fingerprints of whole texts, with DataFrame functions only.

A document keeps its terms within a band of inverse document frequency. Seeded hashes deal the
lexicon into many randomised subsets; per subset the document's distinct terms are sorted and
hashed. Equal texts share all hashes; a changed term changes only the subsets that hold it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_CHARS = 6
NO_TERMS = "." * HASH_CHARS  # a subset that holds none of the document's terms
EIGHT = 8


@dataclass(frozen=True)
class IMatch:
    """Settings of the fingerprints.

    low, high:    the band: low <= ln(documents / df) <= high. The lower limit removes words of
                  more than e^-low of all documents, the upper one words of hardly any.
    rate_bits:    per family of subsets, a term is in a given subset with chance 2^-bits. Dense
                  families tell short texts apart, sparse ones still match long edited texts.
    subsets:      per family, a multiple of eight
    enough:       subsets with terms that a family needs to be compared by itself
    counter_bits: document frequencies are counted in 2^bits hash slots, so that the lexicon is a
                  bitmap of fixed size (2^22 bits are 512 KB); terms of one slot share a count
    seed:         of the subsets
    """

    low: float = 2.5
    high: float = 11.5
    rate_bits: tuple[int, ...] = (5, 8, 11, 14)
    subsets: int = 32
    enough: int = 4
    counter_bits: int = 22
    seed: int = 11

    def band(self, documents: int) -> tuple[int, int]:
        """The least and the largest document frequency inside the band, at least 1."""
        least = max(1, math.ceil(documents * math.exp(-self.high)))
        return least, max(1, math.floor(documents * math.exp(-self.low)))

    def multiplier(self, family: int) -> int:
        """An odd number below 2^31 that mixes 32-bit codes for a family."""
        return int(hashlib.md5(f"{self.seed}|{family}".encode()).hexdigest()[:8], 16) >> 1 | 1


def distinct_terms(text: Column) -> Column:
    """Maximal runs of letters, digits and non-ASCII signs, A-Z lower-cased."""
    # splitting between the terms is less than half the work of extracting them
    return F.array_remove(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), BETWEEN_TERMS)), "")


def fit_lexicon(docs: DataFrame, settings: IMatch, text_col: str = "text") -> list[int]:
    """The hash slots of all terms inside the band, as a bitmap of 64-bit words.

    One pass over all whole texts; (slot, count) pairs are combined map-side. At most
    2^(counter_bits - 6) words reach the driver, whatever the number of documents.
    """
    least, most = settings.band(docs.count())
    slot = F.crc32("term") % (1 << settings.counter_bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = (
        docs.select(F.explode(distinct_terms(F.col(text_col))).alias("term"))
        .groupBy(slot.alias("slot"))
        .agg(F.count("*").alias("df"))
        .where(F.col("df").between(least, most))
        .groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .collect()
    )
    bitmap = [0] * (1 << settings.counter_bits - 6)
    for row in words:
        bitmap[row["word"]] = row["bits"]
    return bitmap


def long_array(values: list[int]) -> Column:
    """A constant array; the optimiser folds it into one literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def add_hashes(df: DataFrame, text_col: str, name: str, bitmap: list[int], settings: IMatch) -> DataFrame:
    """``df`` with ``name``: one hash per subset, NO_TERMS where a text has no term in it.

    A text without any term in the band has one hash, that of the whole text, so that only
    equal ones of these texts are alike.
    """
    words = long_array(bitmap)
    in_band = F.filter(
        F.transform(distinct_terms(F.col(text_col)), lambda t: F.struct(t.alias("t"), F.crc32(t).alias("c"))),
        lambda x: F.getbit(
            F.get(words, F.shiftright(x["c"] % (1 << settings.counter_bits), 6).cast("int")), x["c"] % 64
        )
        == 1,
    )
    families = range(len(settings.rate_bits))

    def place(code: Column, family: int) -> Column:
        mixed = (code * F.lit(settings.multiplier(family))).bitwiseAND(F.lit((1 << 32) - 1))
        return F.shiftright(mixed, 32 - settings.rate_bits[family]).cast("int")

    def subset_hash(chosen: Column) -> Column:
        joined = F.array_join(F.transform(chosen, lambda x: x["t"]), " ")
        return F.when(F.size(chosen) > 0, F.left(F.md5(joined), F.lit(HASH_CHARS))).otherwise(F.lit(NO_TERMS))

    def family_hashes(family: int) -> Column:
        # the family's terms, by place modulo eight, then by place: few looks at each term
        p, eighths, rest = f"p{family}", numbers(EIGHT), numbers(settings.subsets // EIGHT)
        mine = F.array(F.filter("_dealt", lambda x: x[p] < settings.subsets))
        parts = F.transform(mine, lambda m: F.transform(eighths, lambda e: F.filter(m, lambda x: x[p] % EIGHT == e)))
        subsets = F.transform(
            F.flatten(parts), lambda m: F.transform(rest, lambda k: F.filter(m, lambda x: F.shiftright(x[p], 3) == k))
        )
        return F.transform(F.flatten(subsets), subset_hash)

    dealt = F.transform(
        F.sort_array(in_band),
        lambda x: F.struct(x["t"].alias("t"), *[place(x["c"], f).alias(f"p{f}") for f in families]),
    )
    hashes = F.when(F.size("_dealt") > 0, F.concat(*[family_hashes(f) for f in families]))
    return (
        df.withColumn("_dealt", dealt)
        .withColumn(name, hashes.otherwise(F.array(F.md5(F.col(text_col)))))
        .drop("_dealt")
    )


def likeness(one: Column, other: Column, settings: IMatch = IMatch()) -> Column:
    """How alike two lists of hashes are, from 0 to 1.

    Per family the share of equal hashes among the subsets in which either text has terms; of
    these the largest, as the family whose subsets hold about one term each tells most. A
    family counts if at least ``settings.enough`` of its subsets hold terms; without such a
    family all subsets are taken together.
    """
    none, families, size = F.lit(NO_TERMS), len(settings.rate_bits), settings.subsets
    pairs = F.zip_with(
        one,
        other,
        lambda x, y: F.when(
            (F.coalesce(x, none) != none) | (F.coalesce(y, none) != none),
            F.coalesce(x == y, F.lit(False)).cast("int"),
        ),
    )

    def share(values: Column, least: int) -> Column:
        told = F.filter(values, lambda v: v.isNotNull())
        same = F.aggregate(told, F.lit(0), lambda a, v: a + v)
        return F.when(F.size(told) >= least, same / F.size(told))

    shares = [share(F.slice(pairs, f * size + 1, size), settings.enough) for f in range(families)]
    best = F.greatest(*shares) if families > 1 else shares[0]
    return F.coalesce(best, share(pairs, 1))


def below(edges: list[int], value: Column) -> Column:
    """How many of the ascending edges are smaller than the value, by binary search; NULL: none."""
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    if not steps:
        return F.lit(0)
    found = long_array(edges)
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(found, at + step - 1) < value, at + step).otherwise(at),
    )


def with_next(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    blocks: int | None = None,
) -> DataFrame:
    """``id_col``, ``text_col`` and what ``prepare`` adds, each also as ``next_...`` of the next row.

    Rows stand in descending order of their (integer) id, NULL last, equal ids by text; the
    first follows the last. Ids are cut into ``blocks`` ranges of about equal numbers of rows
    (four per shuffle partition), and the texts are shuffled once, to their block. The first
    rows of a block also go to the block before, as guests that are only looked at, so that no
    block needs another one. ``prepare`` runs after the shuffle, once per row.
    """
    rows = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    blocks = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / blocks) for k in range(1, blocks)]) if blocks > 1 else F.array(F.lit(0.5))
    edges = rows.agg(F.percentile_approx("_i", shares, 50 * blocks).alias("e")).first()["e"] or []
    edges = sorted(set(edges)) if blocks > 1 else []
    block = F.lit(len(edges)) - below(edges, F.col("_i"))
    ends = rows.groupBy(block.alias("b")).agg(F.max("_i").alias("head")).collect()
    heads, known, before = ([0] * (len(edges) + 1) for _ in range(3))
    present = sorted(row["b"] for row in ends)
    for row in ends:
        heads[row["b"]], known[row["b"]] = row["head"] or 0, int(row["head"] is not None)
    for at, b in enumerate(present):
        before[b] = present[at - 1]
    head = F.when(F.get(long_array(known), F.col("_own")) == 1, F.get(long_array(heads), F.col("_own")))
    guest = F.when(
        head.eqNullSafe(F.col("_i")),
        F.array(
            F.struct(F.col("_own").cast("bigint").alias("b"), F.lit(False).alias("guest")),
            F.struct(F.get(long_array(before), F.col("_own")).alias("b"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("_own").cast("bigint").alias("b"), F.lit(False).alias("guest"))))
    dealt = (
        rows.withColumn("_own", block)
        .select("_i", "_t", F.explode(guest).alias("_to"))
        .select("_i", "_t", F.col("_to.b").alias("_block"), F.col("_to.guest").alias("_guest"))
        .repartition("_block")
        .select("_block", "_guest", F.col("_i").alias(id_col), F.col("_t").alias(text_col))
    )
    ready = prepare(dealt)
    order = Window.partitionBy("_block").orderBy("_guest", F.col(id_col).desc_nulls_last(), text_col)
    given = [c for c in ready.columns if c not in ("_block", "_guest")]
    return (
        ready.withColumns({f"next_{c}": F.lead(c).over(order) for c in given}).where("NOT _guest").drop("_block", "_guest")
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many (or all) of another text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.left(text, F.char_length(text) - third), F.left(following, third))


def fingerprint_documents(
    docs: DataFrame, settings: IMatch = IMatch(), id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None
) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Returns ``<id_col>, <text_col>, edited_text, hashes, next_hashes, edited_hashes``: the hashes
    per subset of the text, of the next document's (descending ids, see ``with_next``) and of
    ``edited_text``. A NULL text is an empty one. Equal texts have equal hashes, whatever their
    ids. Texts without terms in the band, empty ones among them, are only like equal texts.
    Repeated rows are each other's next document; a single row is its own. Rows without id
    come last. Very long texts are treated whole. Other columns, whatever their names, are
    not read; an empty table gives no rows.
    """
    bitmap = fit_lexicon(docs, settings, text_col)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ring = with_next(own, "_id", "_text", lambda df: add_hashes(df, "_text", "hashes", bitmap, settings), blocks)
    edited = ring.withColumn("edited_text", edited_text(F.col("_text"), F.col("next__text"))).drop("next__text")
    return add_hashes(edited, "edited_text", "edited_hashes", bitmap, settings).select(
        F.col("_id").alias(id_col), F.col("_text").alias(text_col), "edited_text", "hashes", "next_hashes", "edited_hashes"
    )
