"""Structured Streaming jobs for incoming tickets."""
