"""Operators for preparing training data: each module holds one operator, ``queries`` the thin ``opN_`` queries.

Nothing else in the library imports this subpackage.
"""
