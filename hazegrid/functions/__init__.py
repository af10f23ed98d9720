"""Scalar and aggregate Column helpers."""
