"""Training-data operators: ten components over a ``documents`` table."""
