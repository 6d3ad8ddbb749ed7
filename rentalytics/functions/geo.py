"""Great-circle distance as a native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(float(c))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Haversine distance in km; any NULL coordinate gives NULL.

    ``sqrt(a)`` can drift just above 1 through rounding, where ``asin`` would
    give NaN; it is clamped with ``when`` (``least`` would turn a NULL into 1).
    """
    lon1, lat1, lon2, lat2 = (F.radians(_col(c)) for c in (lon1, lat1, lon2, lat2))
    a = (F.pow(F.sin((lat2 - lat1) / 2.0), 2)
         + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2.0), 2))
    root = F.sqrt(a)
    clamped = F.when(root > 1.0, F.lit(1.0)).otherwise(root)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(clamped)
