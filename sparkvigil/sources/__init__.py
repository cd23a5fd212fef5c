"""Readers, writers and control tables."""
