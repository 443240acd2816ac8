"""A Spark-native engine for image-sequence and 3-D reconstruction tables."""
