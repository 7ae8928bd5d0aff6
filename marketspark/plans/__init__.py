"""Snapshots, reports, the registered query catalog and its DuckDB oracle SQL."""
