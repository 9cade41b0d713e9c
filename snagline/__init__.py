"""Friction-report analytics as Spark DataFrame jobs."""
