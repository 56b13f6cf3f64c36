"""A hash that every SQL engine can compute, for splits and samples that others must reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash is this many leading hex digits of an md5, so it fits a bigint.
HEX_DIGITS = 15


def portable_hash(key: Column, seed: int = 42) -> Column:
    """Non-negative bigint of the key's text and a seed; null for a null key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, HEX_DIGITS), 16, 10).cast("bigint")
