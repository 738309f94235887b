"""Spark code-graph operators: sources."""
