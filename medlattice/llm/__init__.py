"""Operators for preparing training text: near and exact duplicate removal,
language, quality, packing, decontamination, secrets, licences, vector search.

Nothing else in the library imports this package.
"""
