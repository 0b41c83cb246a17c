"""Training-data operators: near-duplicates, fingerprints, search, privacy, filters, packing, scoring.

Nothing else in the library imports this subpackage.
"""
