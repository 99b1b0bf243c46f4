"""Operators of a training-data pipeline over a `documents` table.

One module per operator; `registry` binds each of them to a query. Nothing
else in the library imports this package.
"""
