"""Operators of a training-data pipeline: near-duplicate joins, token files, BPE, pseudonyms, media
columns, vector search, toxicity, URL rules, line dedup and mixing.

Nothing outside this package imports it. ``queries.py`` registers the thin ``opN_*`` queries.
"""
