"""Named queries over the domain frames, with their SQL for DuckDB."""

from . import currencies, curves, market, membership, records, research, screens, upkeep

MODULES = (market, currencies, membership, research, screens, records, curves, upkeep)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
