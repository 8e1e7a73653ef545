"""Operators for preparing text corpora: formatting, search, filters, encoding, mixing and duplicate removal.

Nothing else in the library imports this subpackage.
"""
