"""Named queries, grouped by subject; importing this package registers them all."""

from sightline.registry import curate, places, dashboard, guide, live  # noqa: F401, I001
from sightline.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
