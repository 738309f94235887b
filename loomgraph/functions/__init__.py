"""Spark code-graph operators: functions."""
