"""lakewright: a Spark-first engine for a developer-knowledge lake."""
