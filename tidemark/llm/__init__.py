"""Operators for large training-text corpora.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; `queries` registers one query per operator.
"""
