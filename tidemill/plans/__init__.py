"""Composed plans: query catalogue and pipelines."""
