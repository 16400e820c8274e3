"""Structured Streaming jobs that wrap the batch operators."""
