"""Structured Streaming jobs over the trace."""
