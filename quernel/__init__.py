"""Text analytics on Spark: ingest, segment, score, aggregate, extract, evaluate, route.

Importing this package doesn't import pyspark; its subpackages do.
"""
