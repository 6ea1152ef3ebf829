"""Column expressions: text, numbers, vectors, scores."""
