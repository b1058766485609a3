"""Readers and writers of library tables."""
