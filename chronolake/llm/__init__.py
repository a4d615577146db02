"""Training-data operators: dedup, joins, classifiers, filters, archives and mixing.

Nothing else in the library imports this subpackage.
"""
