"""Spark-native network-flow analytics."""
