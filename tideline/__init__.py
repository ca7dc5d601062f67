"""Review-sentiment analytics as Spark DataFrame jobs, over all products at once."""
