"""Anchor and target sequence statistics on Spark."""
