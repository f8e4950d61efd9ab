"""Spark-native wildfire exposure analytics and training-data operators."""
