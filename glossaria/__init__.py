"""Vocabulary analytics on Spark."""
