"""Column functions and SQL registration."""
