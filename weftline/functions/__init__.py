"""Column functions and small distributed building blocks."""
