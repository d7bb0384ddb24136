"""Catalog and tables."""
