"""Evidence-preserving analytics as Spark jobs."""
