"""Operators over operation logs: DataFrame in, DataFrame out."""
