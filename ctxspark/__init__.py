"""Spark-first relational, snapshot and agent-memory analytics."""

__version__ = "0.1.0"
