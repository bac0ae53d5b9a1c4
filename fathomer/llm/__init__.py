"""Operators that prepare text corpora for model training.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
