"""Spark-native engine for tabular data quality, synthetic data and corpus preparation."""
