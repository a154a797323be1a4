"""Spark-first document analytics and hybrid retrieval."""
