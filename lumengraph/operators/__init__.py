"""Relational operators: ranked retrieval, graphs, analytics, listings."""
