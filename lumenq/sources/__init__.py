"""Storage: a file system that Spark can reach and versioned tables on it."""
