"""Composed queries over whole tables."""
