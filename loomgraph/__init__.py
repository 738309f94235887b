"""Loomgraph: a PySpark engine for code graphs and for training-data pipelines."""
