"""Operators for text that trains language models; nothing outside this package imports it."""
