"""Readers and writers of catalogue tables."""
