"""Competition-results analytics as composable Spark jobs."""
