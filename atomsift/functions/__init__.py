"""Column expressions: vectors, bins, hash ordering, text."""
