"""Retrieval, verification and corpus analytics on Spark."""
