"""Relational, graph and neural operators."""
