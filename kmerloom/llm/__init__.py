"""Training-data operators: scoring, filtering, near duplicates, archives, mixing and secrets.

Nothing outside this subpackage imports it.
"""
