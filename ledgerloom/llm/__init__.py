"""Training-data operators: filtering, scanning, deduplication, mixing and tokenisation of text corpora.

Nothing else in the library imports this subpackage.
"""
