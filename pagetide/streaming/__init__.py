"""Structured Streaming twins of the run-history operators."""
