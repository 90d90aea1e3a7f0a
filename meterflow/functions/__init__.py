"""Column-level builders (scalar functions)."""
