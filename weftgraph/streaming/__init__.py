"""Streams of atoms."""
