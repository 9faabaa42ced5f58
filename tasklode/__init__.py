"""Spark-native analytics over task catalogs, attempts, episodes and demonstrations."""
