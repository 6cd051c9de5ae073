"""A PySpark-native engine for causal analytics on panels of daily series and for scoring record-matching results."""
