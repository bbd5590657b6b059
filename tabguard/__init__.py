"""PySpark-native tabular data quality, reconciliation and cleaning engine."""
