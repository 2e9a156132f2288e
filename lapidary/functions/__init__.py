"""Scalar column functions and name classifiers."""
