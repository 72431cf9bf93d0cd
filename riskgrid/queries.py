"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from riskgrid.catalogue import assets, chain, climate, gates, places, reports, results, studies  # noqa: F401
from riskgrid.catalogue.base import ORACLES, QUERIES  # noqa: F401
