"""Column functions: everything here builds plain Spark expressions unless noted."""
