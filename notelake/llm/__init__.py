"""Operators for preparing training data. Nothing else in notelake imports this subpackage."""
