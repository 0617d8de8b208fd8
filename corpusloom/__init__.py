"""Corpus structuring and training-data preparation on PySpark."""
