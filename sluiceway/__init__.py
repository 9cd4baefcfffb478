"""Sluiceway: typed dataflow jobs and training-data operators on PySpark."""
