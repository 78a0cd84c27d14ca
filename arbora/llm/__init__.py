"""Operators on names, sets and texts. Nothing outside this subpackage imports it."""
