"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``registry.py`` lists the queries.
"""
