"""Operators over the dictionary's tables; each gives a lazy DataFrame."""
