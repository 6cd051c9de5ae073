"""Predictors by name, comparisons, and the registered queries."""
