"""Operators that need a vocabulary, a model or a table."""
