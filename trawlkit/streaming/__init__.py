"""Incremental extraction over landed fetches."""
