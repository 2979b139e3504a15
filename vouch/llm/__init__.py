"""Operators for preparing language-model training data on Spark.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
