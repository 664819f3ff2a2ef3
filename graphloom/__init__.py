"""PySpark-native property-graph analytics."""
