"""Planning analytics for manufacturing, written as Spark DataFrame jobs."""
