"""Training-data operators: deduplication, decontamination, mixing, tokens and filters.

Nothing else in the library imports this subpackage.
"""
