"""Operators for large training-data corpora, one module each.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries (``opN_<name>`` and ``pipeline``) and their DuckDB SQL.
"""
