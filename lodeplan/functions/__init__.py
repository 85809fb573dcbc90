"""Column-level building blocks, all built from Spark's own functions."""
