"""Operators of a training-data pipeline over documents and pages.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame,
projects the columns it needs (so extra or clashing columns never matter) and
returns a DataFrame of its own columns.
"""
