"""Operators for text and vector training data. Nothing outside this subpackage imports it."""
