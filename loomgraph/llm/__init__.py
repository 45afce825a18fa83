"""Operators for large training-text corpora.

Every module here stands alone: nothing else in the package imports this one.
Operators take a DataFrame and name the columns they read; any other column of
the input is ignored, so clashing names are harmless.
"""
