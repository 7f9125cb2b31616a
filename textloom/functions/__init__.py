"""Column-level text functions."""
