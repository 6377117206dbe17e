"""Transaction-risk analytics and training-data preparation as Spark jobs."""
