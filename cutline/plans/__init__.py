"""Queries over the given tables that put the operators to work."""
