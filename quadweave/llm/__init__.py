"""Operators for large-scale training-data pipelines.

Every operator takes DataFrames and returns DataFrames keyed by the document
id.  Nothing outside this subpackage imports it.
"""
