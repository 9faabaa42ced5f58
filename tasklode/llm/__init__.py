"""Training-data operators: tokenising, packing, deduplication, filtering and scoring of text.

Nothing else in the library imports this subpackage.
"""
