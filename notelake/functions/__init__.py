"""Functions of notelake."""
