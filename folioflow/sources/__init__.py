"""Readers and writers of the stage tables."""
