"""Operators for training text. Nothing outside of this folder imports it."""
