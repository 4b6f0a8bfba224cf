"""Comment intelligence on Spark: source files, comments and findings as distributed tables."""
