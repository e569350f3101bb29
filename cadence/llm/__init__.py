"""Operators of a training-data pipeline: one module per operator, plus
``queries`` (the registered ``opN_`` queries and their DuckDB SQL).

Nothing else in the library imports this subpackage.
"""
