"""Column functions and label tables."""
