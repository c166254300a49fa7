"""Point-in-time analytics on Spark: as-of graphs, retrieval, features, metrics and corpus operators."""
