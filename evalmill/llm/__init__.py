"""Operators for text and training-data work; nothing outside this subpackage imports it."""
