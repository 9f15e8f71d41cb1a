"""Operators that prepare text for training language models.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and
column names, reads whole texts, and treats a missing text as an empty one.
"""
