"""Site-and-night analytics, and corpus preparation, as Spark DataFrame operators."""
