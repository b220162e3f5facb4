"""Reproducible pseudo-random order from (seed, row id).

``md5(seed ':' id)`` depends only on the row, never on partitioning or task retries, so a
shuffle, a sample or a split gives the same rows on 8 threads and on 1,000 executors, and the
same order can be written in any SQL engine that has ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipframe.functions.util import as_col

TWO_POW_32 = 4294967296.0


def hash_key(seed, *ids) -> Column:
    """Hex md5 of ``seed:id[:id...]``: the sort key for shuffles and samples."""
    parts = [F.lit(str(seed))] + [as_col(i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts))


def uniform01(key) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of a hex md5 key."""
    return F.conv(F.substring(as_col(key), 1, 8), 16, 10).cast("long") / F.lit(TWO_POW_32)


def hash_bucket(key, hex_chars: int = 4) -> Column:
    """Order-preserving bucket of a hex key (16**hex_chars buckets, uniform in size)."""
    return F.conv(F.substring(as_col(key), 1, hex_chars), 16, 10).cast("int")
