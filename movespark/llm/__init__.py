"""Operators for building training data: mixing, scoring, filtering, de-duplication and tokenization."""
