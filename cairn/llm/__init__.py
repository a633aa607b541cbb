"""Operators on page text for language-model training data."""
