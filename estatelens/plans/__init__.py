"""Composed plans: the pipeline and the named queries with their SQL."""
