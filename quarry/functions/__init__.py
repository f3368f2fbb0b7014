"""Column functions and small pure functions."""
