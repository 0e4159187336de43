"""Scalar functions: columns to columns, on the JVM."""
