"""Spark-native document extraction and analytics."""
