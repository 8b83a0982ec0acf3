"""Spark-native dictionary analytics: lookups, phrase search, variant graphs, vector search, and corpus operators."""
