"""Training-data operators: scans, filters, joins and packing over large corpora.

Nothing else in the library imports this subpackage.
"""
