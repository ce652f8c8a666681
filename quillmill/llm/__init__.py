"""Operators for building language-model training data, each usable on its own."""
