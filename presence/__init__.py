"""presence: liveness and presentation-attack analytics on Spark DataFrames."""

from presence.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
