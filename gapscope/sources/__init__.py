"""Reading the source tables and writing the per-run tables."""
