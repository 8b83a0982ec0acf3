"""Structured Streaming forms of the operators on what users do."""
