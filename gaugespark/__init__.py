"""gaugespark: evaluation analytics and corpus preparation as Spark jobs."""
