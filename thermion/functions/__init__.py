"""Column expressions and scalar functions: rounding, statistics, geodesy, scoring formulas, wind."""
