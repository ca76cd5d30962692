"""A PySpark-native engine for checking and completing knowledge graphs."""
