"""Grouped and per-page operators: parsing, extraction, frontier, merging and ranking."""
