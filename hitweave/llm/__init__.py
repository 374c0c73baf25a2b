"""Operators for large text and vector collections."""
