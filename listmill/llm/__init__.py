"""Operators for preparing language-model training text.

One module per operator; ``queries`` registers their named queries. Nothing else in the library imports this package.
"""
