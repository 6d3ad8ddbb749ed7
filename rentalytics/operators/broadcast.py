"""Broadcast joins behind a size check.

A side is broadcast only when its row count and byte size were measured to
be under bounds; beyond them the join stays a shuffle join (AQE may still
convert it at run time from real shuffle statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Lookup sides are broadcast up to this many rows and this many bytes.
DEFAULT_MAX_ROWS = 200_000
DEFAULT_MAX_BYTES = 64 * 1024 * 1024
FIXED_WIDTH_BYTES = 8


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
                       max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` if ``df`` measures at most ``max_rows`` rows and
    ``max_bytes`` bytes (text/binary byte lengths plus 8 bytes per other
    value), else ``df`` for a shuffle join.

    The check reads one row more than the bound at most and keeps nothing.
    """
    var = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    fixed = len(df.columns) - len(var)
    var_bytes = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c in var), F.lit(0))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(var_bytes).alias("b")).first()
    n, size = row["n"], (row["b"] or 0) + row["n"] * fixed * FIXED_WIDTH_BYTES
    if n <= max_rows and size <= max_bytes:
        return F.broadcast(df)
    return df


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast a frame that is one row by construction (a global aggregate)."""
    return F.broadcast(df)
