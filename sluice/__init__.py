"""Keyed, staged batch pipelines on Spark."""
