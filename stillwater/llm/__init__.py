"""Operators for preparing large text and vector collections.

Each module holds one operator with a general interface; ``queries`` holds the
thin queries that apply them to the given tables.  Nothing outside this
subpackage imports it.
"""
