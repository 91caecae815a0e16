"""Operators for training data from conversation archives. Nothing else in the library imports this subpackage."""
