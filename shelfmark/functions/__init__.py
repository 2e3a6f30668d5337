"""Column expressions and fixed word lists."""
