"""Operators for building training corpora: one module per operator.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL.
"""
