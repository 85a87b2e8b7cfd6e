"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin queries and their SQL.
"""
