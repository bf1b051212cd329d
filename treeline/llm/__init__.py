"""Operators for text and code collections that train language models; nothing outside imports this package."""
