"""Named queries composed from the operators, with their DuckDB oracles."""
