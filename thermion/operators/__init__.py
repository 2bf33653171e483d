"""Operators over DataFrames: windows, joins, aggregates, detectors, grouping and search."""
