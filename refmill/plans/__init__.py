"""Whole queries composed of the operators, and their registry."""
