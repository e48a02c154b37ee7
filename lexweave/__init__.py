"""Document analytics and graph retrieval on Spark."""
