"""Operators of notelake."""
