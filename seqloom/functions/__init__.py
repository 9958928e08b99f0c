"""Scalar functions on words, as column expressions and as SQL functions."""
