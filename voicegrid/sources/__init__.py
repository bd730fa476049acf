"""Readers and writers for review tables."""
