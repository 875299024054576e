"""Column builders: bands, probabilities, texts."""
