"""Training-data operators: counts, codecs, formatting, privacy, mixing, scoring and near-duplicates.

Nothing else in the library imports this subpackage.
"""
