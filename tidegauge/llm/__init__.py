"""Operators on the text of a training corpus."""
