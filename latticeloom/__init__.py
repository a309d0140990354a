"""Spark-native tables of atomic structures, descriptors and materials data."""
