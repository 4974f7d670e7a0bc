"""Operators for preparing training text at scale.

One module per operator; ``queries`` holds the thin registered queries and their
SQL twins. Nothing else in the library imports this package.
"""
