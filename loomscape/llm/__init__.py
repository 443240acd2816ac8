"""Training-data operators: filters, near-duplicate search, extraction, packing, scoring.

Nothing else in the library imports this subpackage.
"""
