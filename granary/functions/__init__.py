"""Scalar functions on bytes, names and numbers, as column expressions."""
