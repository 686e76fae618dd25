"""Query plans over the driver's tables: fixtures, query registry, DuckDB oracles."""
