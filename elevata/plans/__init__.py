"""All queries of the engine by name, with DuckDB equivalents."""

from . import analysis, geometry, matching, metrics, report, scale, scene, text

MODULES = (report, text, matching, scale, scene, metrics, geometry, analysis)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
