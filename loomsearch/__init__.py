"""Full-text search and web-corpus analytics in Spark DataFrame operations."""
