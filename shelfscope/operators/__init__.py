"""Operators: DataFrame in, DataFrame out. Dates are arguments, never the clock."""
