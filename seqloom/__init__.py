"""Sequence analytics on Spark: batched positional queries over indexed sequences."""
