"""Scalar column functions and the predicate translator."""
