"""Column functions: every one is a built-in Spark expression, no Python per row."""
