"""Named query plans, their DuckDB oracles and the end-to-end pipeline."""
