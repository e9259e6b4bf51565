"""visitprep: a PySpark-native engine for preparing visit-level records."""
