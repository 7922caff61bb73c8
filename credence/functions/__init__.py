"""Column expressions: row-local, built from Spark's own functions."""
