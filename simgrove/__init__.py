"""Similarity analytics on Spark: graph and sequence features, SimHash, LSH search, weight learning, evaluation."""
