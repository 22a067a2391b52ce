"""Statistical climate downscaling and corpus preparation as Spark jobs."""
