"""Column expressions and small shared plan fragments used by the operators."""
