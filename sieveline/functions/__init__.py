"""Column builders: text, scores, vectors."""
