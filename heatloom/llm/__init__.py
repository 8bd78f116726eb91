"""Operators that prepare training data for language models, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
