"""Abundix: feature-by-sample measurement analytics as Spark DataFrame jobs."""
