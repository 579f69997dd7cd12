"""Column functions and generators."""
