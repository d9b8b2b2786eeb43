"""Plans: the questions (Q1-Q12) and the registered queries with their DuckDB oracles."""
