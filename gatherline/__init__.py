"""Spark-native analytics over crowd, queue and order data of large venues."""
