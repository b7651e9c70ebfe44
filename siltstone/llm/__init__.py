"""Operators for building training data from text, code and vectors."""
