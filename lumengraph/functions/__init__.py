"""Scalar functions: text, dates, vectors, note transforms."""
