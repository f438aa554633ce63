"""Fixtures over the driver's tables, the query catalogue, and whole pipelines."""
