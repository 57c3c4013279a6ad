"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames; the
thin contract queries that derive digest columns from them are in ``voxmill.llm.queries``.
"""
