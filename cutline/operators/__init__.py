"""DataFrames to DataFrames: segments, searches, ledgers, matching."""
