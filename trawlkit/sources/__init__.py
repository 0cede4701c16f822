"""Where pages, seeds and tasks come from, and where results go."""
