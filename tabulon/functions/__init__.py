"""Scalar functions of the language."""
