"""Scalar functions as Column expressions, all inside code generation."""
