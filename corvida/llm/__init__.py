"""Operators that prepare training text, each with its queries and SQL.

Nothing outside this package imports it.
"""
