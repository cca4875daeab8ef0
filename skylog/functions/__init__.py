"""Column builders: every function takes and returns Spark columns, no Python per row."""
