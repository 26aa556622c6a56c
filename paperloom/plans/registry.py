"""All queries of the engine and their DuckDB statements."""

from ..operators import boxes, catalog, evaluate, extract, features, layout, models, text_jobs
from ..sources import readers, snapshots, truth
from ..streaming import lifecycle

MODULES = (catalog, evaluate, boxes, text_jobs, features, layout, extract, models, readers, snapshots, truth, lifecycle)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
