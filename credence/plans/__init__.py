"""Registered queries: each entry runs over the whole of the given tables."""
