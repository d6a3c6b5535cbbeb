"""Operators for preparing training data. Nothing outside of this folder imports it."""
