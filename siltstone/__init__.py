"""Code retrieval, ranking and evaluation as declarative Spark jobs."""
