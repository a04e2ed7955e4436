"""Column expressions: row-local building blocks, no shuffles."""
