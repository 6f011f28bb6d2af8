"""Operators for large-scale training-data preparation.

Self-contained: nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""
