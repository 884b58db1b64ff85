"""Column functions that the engine adds to Spark's."""
