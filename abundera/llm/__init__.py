"""Operators for language-model training data and the algorithms they share."""
