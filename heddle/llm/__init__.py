"""Operators for preparing training text: one module per operator.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a DataFrame; ``queries`` holds the registered thin queries.
"""
