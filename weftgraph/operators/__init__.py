"""Operators over answers, stores and attention state."""
