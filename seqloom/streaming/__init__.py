"""Sequences that grow as streams."""
