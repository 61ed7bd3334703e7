"""Corpus layout analytics on PySpark."""
