"""Columns to columns: statistics, curves and text patterns."""
