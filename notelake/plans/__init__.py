"""Plans of notelake."""
