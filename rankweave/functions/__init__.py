"""Column expressions and batch hooks."""
