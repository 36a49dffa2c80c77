"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Every operator is a
function ``DataFrame -> DataFrame``; the thin contract queries live in
``queries.py`` and their DuckDB twins in ``oracles.py``.
"""
