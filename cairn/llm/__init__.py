"""Operators for building training data: one module each, `queries` binds them to the tables."""
