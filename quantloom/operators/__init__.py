"""Operators: DataFrame in, DataFrame out, over all symbols at once."""
