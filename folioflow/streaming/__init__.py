"""Structured Streaming jobs of the document flow."""
