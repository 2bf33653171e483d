"""Whole analyses: scoring a field, a series, and the catalogue of queries."""
