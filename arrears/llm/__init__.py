"""Operators for large text and vector corpora (training-data preparation).

Nothing else in the library imports this subpackage. Each module holds one operator with its own
general interface; :mod:`arrears.llm.queries` holds the thin contract queries over the tables.
"""
