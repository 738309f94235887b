"""Spark code-graph operators: streaming."""
