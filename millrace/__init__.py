"""Analytics and corpus processing as Spark jobs."""
