"""Registered queries over the given tables, each next to its oracle SQL."""

from presence.workload import analytics, attempts, captures, decisions, images, inputs, requests, streams  # noqa: F401
from presence.workload.base import REGISTRY

__all__ = ["REGISTRY"]
