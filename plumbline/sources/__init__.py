"""Readers of landed files, writers and derivations of the logical tables."""
