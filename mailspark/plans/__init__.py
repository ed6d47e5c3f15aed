"""Query plans registered with the driver (Spark side and DuckDB oracle side)."""
