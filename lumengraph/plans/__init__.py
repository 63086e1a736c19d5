"""Query catalogue over the driver's tables, with DuckDB equivalents."""
