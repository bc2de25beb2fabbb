"""Readers, writers and tables between steps."""
