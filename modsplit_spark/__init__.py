"""Spark jobs that find natural split points in large modules, for all modules at once."""
