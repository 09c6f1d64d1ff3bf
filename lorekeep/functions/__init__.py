"""Column functions and fixed word lists."""
