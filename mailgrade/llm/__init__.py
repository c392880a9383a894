"""Operators for preparing training text: extraction, dedup, privacy, scoring, packing.

Nothing outside this package imports it.
"""
