"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage. ``registry`` holds the
driver-facing queries and their SQL; every other module holds one operator.
"""
