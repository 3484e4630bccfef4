"""Operators for training-data preparation: mixing, chat formatting, packing, media columns, secret
scans, language labels, token stores, WARC derivatives, exact search and near-duplicate joins.

Nothing else in the library imports this subpackage.
"""
