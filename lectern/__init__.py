"""Lectern: Spark-native analytics over scholarly corpora and their entity graphs."""
