"""tallyspark: competition and event analytics as composable Spark DataFrame transforms."""
