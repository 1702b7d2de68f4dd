"""Training-data operators: scoring, extraction, near duplicates, packing.

Nothing else in the library imports this subpackage.  Each module holds one
operator over plain DataFrames; ``registry.py`` holds the thin registered
queries over the driver tables and their SQL twins.
"""
