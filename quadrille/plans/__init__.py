"""Queries on the tables, and for each the SQL that another engine runs for the same result."""

from . import analysis, config, crops, detect, geometry, jobs, masks, raster, reports, streams, strokes, sweeps, temporal

MODULES = (geometry, raster, strokes, masks, detect, crops, analysis, temporal, config, jobs, reports, streams, sweeps)


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
