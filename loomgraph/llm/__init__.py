"""Operators for large training corpora: filters, near-duplicate joins, search, tokenizing.

Nothing outside this package imports it; it imports nothing from the rest of the library.
"""
