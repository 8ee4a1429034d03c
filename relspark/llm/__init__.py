"""Operators for building training data: copies, contamination, scores, tokens, shards, page text.

Nothing else in the library imports this subpackage. Every operator takes DataFrames with any
columns and treats a null text as the empty text. Ids may be null or repeated.
"""
