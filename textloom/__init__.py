"""A PySpark-native analytics engine for clinical text, its corrections, and the logs around them."""
