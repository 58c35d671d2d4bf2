"""Operators of a training-data pipeline: tokenisation, search, deduplication,
packing and scoring.  Nothing outside this subpackage imports it."""
