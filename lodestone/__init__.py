"""A PySpark-native analytics engine for evidence retrieval and evaluation."""
