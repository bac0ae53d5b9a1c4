"""A PySpark-native engine for symbol search, code-graph analytics and corpus preparation."""
