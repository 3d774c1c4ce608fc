"""Seeded, partition-independent randomness: every random choice is a function of the row's own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *keys: Column | str) -> Column:
    """Sort key of a seeded shuffle: md5 of the seed and the key columns."""
    parts = [F.lit(str(seed))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(seed: int | str, *keys: Column | str) -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(seed, *keys) / F.lit(float(2**32))
