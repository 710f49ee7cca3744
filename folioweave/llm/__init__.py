"""Operators of a training-data pipeline: scoring, deduplication, decontamination, mixing, search, archives.

Nothing else in the package imports this folder.
"""
