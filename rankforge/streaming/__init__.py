"""Streams with state."""
