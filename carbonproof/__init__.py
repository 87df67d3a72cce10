"""Spark-native toolkit for copying datasets and proving that the copy is right."""
