"""Training-data operators: deduplication, tokenising, search, scans, filters, packing and classifiers over text tables.

Nothing else in the library imports this subpackage.
"""
