"""Readers and writers for texts, projects and training pairs."""
