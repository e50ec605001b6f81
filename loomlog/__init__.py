"""A PySpark-native analytics engine for Windows binary event logs."""
