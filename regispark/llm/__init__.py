"""Operators for text that goes into training data. Nothing outside this subpackage imports it."""
