"""Reproducible per-key hash used for folds and splits.

``key_hash(id, seed)`` is the first 8 hex digits of ``md5("<id>:<seed>")`` read
as a non-negative BIGINT.  It depends only on the key, so fold and split
membership is the same for any partitioning, any cluster size and any engine
that has md5 (no ``rand()``, no ``randomSplit``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def key_hash(c, seed: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    digest = F.md5(F.concat(col.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
