"""Native Column builders (no Python UDFs)."""

from .geo import haversine_km
from .hashing import key_hash
from .parse import (
    amenity_column_name,
    amenity_count,
    amenity_flag,
    amenity_list,
    date_text,
    integral_text,
    nan_to_null,
    numeric_text,
    price_text,
    tf_flag,
    truthy_int,
)

__all__ = [
    "amenity_column_name", "amenity_count", "amenity_flag", "amenity_list", "date_text",
    "haversine_km", "integral_text", "key_hash", "nan_to_null", "numeric_text",
    "price_text", "tf_flag", "truthy_int",
]
