"""Training-data operators; queries.py registers them, nothing else in loomgraph imports them."""
