"""Spark-native analytics over sequence evidence: sources, k-mers, intervals, mapping and mapper comparison."""
