"""Spark-native audit of a business-intelligence catalog."""
