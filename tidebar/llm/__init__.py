"""Operators on text collections for training language models; nothing outside this package imports it."""
