"""Name -> query and name -> oracle SQL."""

from tessera.plans import catalog_queries, file_queries, vector_queries

QUERIES = vector_queries.QUERIES | catalog_queries.QUERIES | file_queries.QUERIES
ORACLES = vector_queries.ORACLES | catalog_queries.ORACLES | file_queries.ORACLES
