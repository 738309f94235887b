"""Spark code-graph operators: plans."""
