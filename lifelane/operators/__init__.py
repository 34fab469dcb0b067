"""Operators: DataFrame in, DataFrame out, lazy unless their docstring says otherwise."""
