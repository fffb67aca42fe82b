"""Scalar functions as Column builders; Arrow UDFs only where Spark has no built-in."""
