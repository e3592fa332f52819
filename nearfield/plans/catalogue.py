"""All registered queries of the engine and their SQL."""

from nearfield.plans import ingesting, intervals, library, listing, models, ranking, scalars, sqlfunctions, stateful, vectors  # noqa: F401  each registers its queries
from nearfield.plans._registry import COVERS, FIXED, FIXED_COVERS, ORACLE_SQL, QUERIES

__all__ = ["COVERS", "FIXED", "FIXED_COVERS", "ORACLE_SQL", "QUERIES"]
