"""Training-data operators: filters, deduplication, search, tokenisation and packing.

Nothing else in the library imports this subpackage.
"""
