"""Lignum: a Spark engine for versioned, tree-shaped metadata and change logs."""
