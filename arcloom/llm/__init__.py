"""Training-data operators: similarity joins, classifiers, mixing, tokenising.

Nothing outside this subpackage imports it.
"""
