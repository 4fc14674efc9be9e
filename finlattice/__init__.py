"""Spark-native document question routing, retrieval, claim checking and corpus operators."""
