"""Column expressions and scalar rules."""
