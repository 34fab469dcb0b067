"""Compositions of operators: cohorts and experiments."""
