"""Scalar column helpers and fixed configuration values."""
