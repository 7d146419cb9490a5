"""Sources of notelake."""
