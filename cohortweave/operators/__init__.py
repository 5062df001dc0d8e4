"""Relational cohort operators."""
