"""Document-comprehension analytics as Spark jobs."""
