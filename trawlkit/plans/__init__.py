"""Whole pipelines: contacts per site, and the result surface on top."""
