"""Spark-native engine that turns semi-structured documents into typed records."""
