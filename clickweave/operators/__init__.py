"""Aggregations, joins and windows over typed events (event schema and ts), and queries over the curated tables."""
