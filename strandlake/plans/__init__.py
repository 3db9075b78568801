"""Registered queries. Each module has QUERIES (name -> function of session and folder) and SQL (name -> DuckDB text)."""
