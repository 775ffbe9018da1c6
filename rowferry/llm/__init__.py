"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries; every other module holds one operator with its own interface.
"""
