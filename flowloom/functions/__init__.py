"""Column expressions: scalar formulas and hash-seeded random draws."""
