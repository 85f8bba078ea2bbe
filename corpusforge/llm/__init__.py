"""Training-data operators: tokenising, fingerprints, filters, near-duplicates, scoring, packing.

Nothing outside this subpackage imports it.
"""
