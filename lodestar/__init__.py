"""Document-drive analytics and retrieval as plain Spark jobs."""
