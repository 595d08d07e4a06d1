"""All named queries of the engine."""

from __future__ import annotations

from .functions import scalar_queries  # noqa: F401
from .operators import aggregates, filters, fusion, graph, grid, joins, ordering, projections, raster, rules, simulation, spatial, windows  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
from .sources import source_queries  # noqa: F401
from .streaming import stream_queries  # noqa: F401
