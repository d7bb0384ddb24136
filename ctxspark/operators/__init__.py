"""Operators on DataFrames: special aggregates, statistics, snapshots."""
