"""Operators for training data made of text. Nothing outside this package imports it."""
