"""SQL of the dialect, rewritten to Spark SQL."""
