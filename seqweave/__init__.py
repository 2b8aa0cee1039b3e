"""Ordered-sequence analytics and training-data operators on Spark."""
