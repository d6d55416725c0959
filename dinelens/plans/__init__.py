"""Query plans bound to data: the warehouse of named tables, the registry
of queries and their DuckDB oracle."""
