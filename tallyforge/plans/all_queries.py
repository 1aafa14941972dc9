"""All queries of the engine, by name."""

from tallyforge.plans import cube_queries, etl_queries, file_queries, identity_queries, record_queries
from tallyforge.plans.catalog import QUERIES, SQL

MODULES = (cube_queries, etl_queries, file_queries, identity_queries, record_queries)

__all__ = ["MODULES", "QUERIES", "SQL"]
