"""evidar: annotation evidence analytics as Spark jobs."""
