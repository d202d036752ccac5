"""All registered queries."""
from deltascope.queries import curation_queries, drift_queries, text_queries

_MODULES = [drift_queries, text_queries, curation_queries]
QUERIES = {name: function for module in _MODULES for name, function in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
