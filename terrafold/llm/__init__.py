"""Training-data operators: fingerprints, filters, deduplication, mixing and output.

Self-contained: nothing outside this subpackage imports it.
"""
