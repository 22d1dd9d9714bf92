"""Degradation analytics over fleets of units, as Spark DataFrame operations."""
