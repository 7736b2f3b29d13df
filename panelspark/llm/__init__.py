"""Operators for preparing training text, and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
