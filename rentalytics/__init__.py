"""rentalytics: listing cleaning, review summaries, features and price models on Spark."""

from .config import CleanParams

__all__ = ["CleanParams"]
