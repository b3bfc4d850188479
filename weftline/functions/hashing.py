"""Deterministic pseudo-random numbers derived from row keys.

A hash of the key gives the same answer on every run, engine, partitioning and task retry,
which a generator seeded per partition does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_SPACE = float(1 << HASH_BITS)


def hash60(key: Column, seed) -> Column:
    """The first 60 bits of md5(key|seed) as a non-negative long. ``seed`` may be a column."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return hash60(key, seed) / F.lit(HASH_SPACE)


def hash_bucket(key: Column, seed, buckets: int) -> Column:
    """A bucket number in [0, buckets)."""
    return F.pmod(hash60(key, seed), F.lit(buckets)).cast("int")
