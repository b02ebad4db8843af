"""Training-data operators: extraction, deduplication, mixing, packing and scoring of documents.

Nothing else in the library imports this subpackage.
"""
