"""Structured Streaming versions of folds and counters.  Each runs until the input at hand is used up and returns the table
its sink wrote."""
