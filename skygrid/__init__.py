"""A Spark-native engine for object annotations on very large images."""
