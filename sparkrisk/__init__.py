"""Transaction-risk analytics as Spark plans."""
