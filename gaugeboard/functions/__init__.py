"""Column-level functions: kinds, text, numbers, dates."""
