"""Column expressions and fixed vocabularies."""
