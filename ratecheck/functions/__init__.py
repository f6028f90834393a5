"""Column expressions: keys, value checks, display text."""
