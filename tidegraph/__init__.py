"""Spark-native retrieval and graph analytics over document collections."""
