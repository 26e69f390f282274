"""Scalar functions: column expressions where Spark has the parts, Arrow functions for Unicode and language rules."""
