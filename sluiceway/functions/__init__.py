"""Scalar functions: text, bytes, media kinds and JSON checks."""
