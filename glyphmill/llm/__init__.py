"""Operators for building training corpora.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when it is there.  Every operator takes and returns DataFrames and
names its input columns by parameter.
"""
