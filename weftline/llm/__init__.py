"""Operators for building language-model training corpora on Spark.

Nothing else in the package imports this subpackage.
"""
