"""Operators: DataFrame in, DataFrame out, keyed by recording, deck or job."""
