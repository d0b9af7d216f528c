"""A PySpark-native engine for large text-comment corpora."""
