"""Streaming of notelake."""
