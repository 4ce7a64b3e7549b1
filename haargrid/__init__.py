"""Adaptive dyadic-grid analytics as Spark DataFrame jobs."""
