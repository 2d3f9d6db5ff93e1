"""Ordered key-value analytics on Spark: a versioned write log and the reads, runs and merges over it."""
