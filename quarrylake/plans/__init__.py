"""Composed queries over tables."""
