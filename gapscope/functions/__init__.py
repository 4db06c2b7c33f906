"""Column functions: text rules, vectors, article rules."""
