"""Column expressions: no I/O, no joins, no Python per row."""
