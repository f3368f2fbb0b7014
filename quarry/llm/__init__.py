"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; removing it leaves the
rest of the library intact.
"""
