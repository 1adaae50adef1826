"""Training-data operators: dedup, filtering, tokenising, archives.

Nothing else in the library imports this subpackage.
"""
