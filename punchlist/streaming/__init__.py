"""Structured Streaming forms of the operators that see records as they arrive."""
