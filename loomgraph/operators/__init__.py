"""Spark code-graph operators: operators."""
