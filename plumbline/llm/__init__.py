"""Operators on text corpora, labels and names for training-data work.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is there.
"""
