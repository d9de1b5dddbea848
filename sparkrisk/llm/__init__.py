"""Operators of a training-data pipeline: filters, dedup, search, tokenisation, scoring, packing."""
