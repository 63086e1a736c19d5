"""Structured Streaming: incremental refresh and event windows."""
