"""Statements to DataFrame plans."""
