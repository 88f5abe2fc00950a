"""Streaming forms of the job log operators."""
