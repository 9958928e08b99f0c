"""Batched positional queries."""
