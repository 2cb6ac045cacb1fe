"""Column functions on identifiers and cluster paths."""
