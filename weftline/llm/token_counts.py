"""Exact token counts of a corpus for every context limit, from the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import persist_state

#: lengths are summed up in ranges of so many, then inside a range
RANGE = 1024
#: a run that the encoder's own pattern search, which recurses, need not see
BLANKS = regex.compile(r"\s{5000}")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_length(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str | None = None) -> Column:
    """Tokens of a text under a byte-level BPE given as a file of ranks; NULL and empty have none.

    The ranks (one vocabulary, a few MB at most) are read once and broadcast, so tasks need no
    file. Strings of special tokens are ordinary text. Texts of any length are encoded whole;
    those with very long runs of blanks are cut into the pattern's pieces first, which gives the
    same tokens without the encoder's recursion over the run.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    with open(tokenizer, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast((file.read(), pattern))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(*ranks.value)
        pieces = regex.compile(ranks.value[1])
        for batch in texts:
            yield pd.Series([count_tokens(t, encoding, pieces) if t else 0 for t in batch], dtype="int64")

    return count(F.col(text_col))


def count_tokens(text: str, encoding, pieces: regex.Pattern) -> int:
    if BLANKS.search(text) is None:
        return len(encoding.encode_ordinary(text))
    return sum(len(encoding._encode_single_piece(piece.group())) for piece in pieces.finditer(text))


def load_encoding(ranks: bytes, pattern: str):
    import base64

    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def length_histogram(docs: DataFrame, length: Column) -> DataFrame:
    """``length``, ``docs``: how many rows have each encoded length; combined before the shuffle."""
    return docs.select(length.alias("length")).groupBy("length").agg(F.count("*").alias("docs"))


def length_table(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, answering every question about a context limit.

    docs_longer, tokens_longer: suffix sums over greater lengths
    truncated_total:            tokens that remain if texts are cut at ``length``
    quantile:                   share of documents of at most ``length`` tokens
    total_docs, total_tokens:   of the corpus

    Sums run over ranges of RANGE lengths first, so a task sees the lengths of one range or one
    row per range. An empty table gives no rows.
    """
    hist = persist_state(histogram.withColumn("_range", F.floor(F.col("length") / RANGE)), "lengths")
    tokens = F.col("length") * F.col("docs")
    ranges = hist.groupBy("_range").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    after = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "_range",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("_t"),
        F.sum("d").over(all_of).alias("total_docs"),
        F.sum("t").over(all_of).alias("total_tokens"),
    )
    inside = Window.partitionBy("_range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = hist.join(ranges, "_range").select(
        "length",
        "docs",
        (F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("_d")).alias("docs_longer"),
        (F.coalesce(F.sum(tokens).over(inside), F.lit(0)) + F.col("_t")).alias("tokens_longer"),
        "total_docs",
        "total_tokens",
    )
    return longer.select(
        "length",
        "docs",
        "docs_longer",
        "tokens_longer",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def length_quantile(table: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents don't exceed."""
    row = table.where(F.col("quantile") >= q).agg(F.min("length")).first()
    return row[0] if row else None


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens that remain if every text is cut at ``limit`` (any number, it need not occur)."""
    above = table.where(F.col("length") > limit).agg(F.max("docs_longer").alias("d"), F.max("tokens_longer").alias("t"),
        F.min(F.struct("length", "docs")).alias("first"), F.max("total_tokens").alias("total")).first()
    if above["total"] is None:
        row = table.agg(F.max("total_tokens")).first()
        return row[0] or 0
    docs = above["d"] + above["first"]["docs"]
    tokens = above["t"] + above["first"]["docs"] * above["first"]["length"]
    return above["total"] - tokens + limit * docs
