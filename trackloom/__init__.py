"""Spark-first trajectory, matching and evaluation analytics."""
