"""Training-data operators: scoring, tokenizing, cleaning, deduplicating and packing text.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
