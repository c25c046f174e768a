"""Vectrove: typed vector collections, nearest-neighbour search and SQL on PySpark."""
