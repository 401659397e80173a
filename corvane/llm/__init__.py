"""Training-data operators: dedup, tokens, mixing, scans, packing and search.

Nothing else in the package imports this subpackage; it may be removed whole.
"""
