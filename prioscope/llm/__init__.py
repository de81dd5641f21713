"""Operators of a training-data pipeline: dedup, filters, search, scoring, mixing, packing.

Nothing else in the library imports this subpackage; ``queries.py`` registers one query
``opN_<name>`` per operator and ``corpus_pipeline.py`` (repository top) chains five of them.
"""
