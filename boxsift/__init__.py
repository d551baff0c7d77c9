"""Spark-native rule and layout analytics over recognised text."""
